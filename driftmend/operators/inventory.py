"""Audits of file indexes and directory manifests, over all backups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmend.functions.columns import differs
from driftmend.operators.digest import table_digest
from driftmend.operators.repair import gate

# Bits and lengths of the file records.
FILE_FLAG = 1
TYPE_MASK, REGULAR = 0xF000, 0x8000
CLASSES = (1, 3, 4)
KEY_LENGTH = 44

PREFIX, SUFFIX = "store/", "/messages/main[.]db"
DOMAINS = ("AppDomain", "GroupDomain")
JOURNALS = ("-wal", "-journal")


def is_regular() -> Column:
    """Flagged as a file, and regular by its mode where there is one."""
    return (F.col("flags").bitwiseAND(FILE_FLAG) != 0) & F.coalesce(F.col("mode").bitwiseAND(TYPE_MASK) == REGULAR, F.lit(True))


def file_index_scan(index: DataFrame, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """Files and bytes of the given domains per backup."""
    return index.filter(F.col("domain").isin(*domains)).groupBy("backup_id", "domain").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def file_index_lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records at the wanted places (domain, path), in whichever backup, with the place of their content."""
    payload = F.concat(F.substring("file_id", 1, 2), F.lit("/"), F.col("file_id"))
    return index.join(wanted.select("domain", "path").distinct(), ["domain", "path"]).select("backup_id", "domain", "path", "file_id", payload.alias("payload"), "size")


def file_id_mismatch(index: DataFrame) -> DataFrame:
    """Records whose id isn't the SHA-1 of domain-path."""
    expected = F.sha1(F.concat("domain", F.lit("-"), "path"))
    return index.filter(differs(expected, F.col("file_id"))).select("backup_id", "path", "file_id", expected.alias("expected_id"))


def stores(index: DataFrame) -> DataFrame:
    """Records flagged as files that are a message store, with their account directory."""
    account = F.regexp_extract("path", f"^{PREFIX}(P_u[^/]*){SUFFIX}$", 1)
    return index.filter(F.col("flags").bitwiseAND(FILE_FLAG) != 0).withColumn("account", account).filter(F.col("account") != "")


def store_discovery(index: DataFrame, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """(backup_id, domain, path, account, place): stores, placed in their backup by domain priority, then path.

    A domain without priority isn't searched.
    """
    found = stores(index).filter(F.col("domain").isin(*domains)).withColumn("priority", F.array_position(F.lit(list(domains)), F.col("domain")))
    listed = found.groupBy("backup_id").agg(F.array_sort(F.collect_list(F.struct("priority", "path", "domain", "account"))).alias("s"))  # a backup's few accounts
    return listed.select("backup_id", F.posexplode("s").alias("place", "s")).select("backup_id", "s.domain", "s.path", "s.account", F.col("place").cast("long").alias("place"))


def store_siblings(index: DataFrame) -> DataFrame:
    """(backup_id, path, sibling, size): files in a store's own directory, not below it."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    store = stores(index).select("backup_id", "domain", F.col("path").alias("store"), folder.alias("folder"))
    files = index.withColumn("folder", folder)
    return store.join(files, ["backup_id", "domain", "folder"]).filter(F.col("path") != F.col("store")).select("backup_id", F.col("store").alias("path"), F.col("path").alias("sibling"), "size")


def pending_journals(index: DataFrame) -> DataFrame:
    """Siblings that hold changes not yet in their store: a journal of its name with content."""
    names = [F.concat("path", F.lit(suffix)) for suffix in JOURNALS]
    return store_siblings(index).filter(F.col("sibling").isin(*names) & (F.coalesce("size", F.lit(0)) > 0))


def file_policy(index: DataFrame, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(backup_id, path, patchable, issues): why a store may not be patched, comma-joined."""
    pending = pending_journals(index).groupBy("backup_id", "path").agg(F.count("*").alias("journals"))
    c = F.col("protection_class")
    issue = lambda when, name: F.when(when, F.lit(name))
    issues = F.array_compact(
        F.array(
            issue(c.isNotNull() & ~c.isin(*classes), "unsupported class"), issue(c.isNull(), "no class"), issue(~F.col("has_key"), "no key"),
            issue(F.col("has_digest"), "has digest"), issue(~is_regular(), "not a regular file"), issue(F.col("journals") > 0, "pending journal"),
        )
    )
    return stores(index).join(pending, ["backup_id", "path"], "left").select("backup_id", "path", (F.size(issues) == 0).alias("patchable"), F.array_join(issues, ",").alias("issues"))


def key_blob_check(index: DataFrame) -> DataFrame:
    """(backup_id, path, status) of stores: does the key blob (hex) have its length, and its first four bytes, little-endian, the class?"""
    blob = F.col("key_blob")
    number = F.conv(F.concat(*[F.substring(blob, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    status = F.when(blob.isNull(), "no key").when(F.length(blob) != 2 * KEY_LENGTH, "wrong length").when(differs(number, F.col("protection_class").cast("long")), "class differs").otherwise("ok")
    return stores(index).select("backup_id", "path", status.alias("status"))


def backup_admission(backups: DataFrame) -> DataFrame:
    """(backup_id, name, admitted, reason): the first rule that a backup fails."""
    reason = (
        F.when(differs(F.col("snapshot_state"), F.lit("finished")), "unfinished").when(~F.coalesce("is_encrypted", F.lit(False)), "not encrypted")
        .when(~F.coalesce("has_keybag", F.lit(False)), "no key").when(differs(F.col("manifest_key_length"), F.lit(KEY_LENGTH)), "wrong key length")
    )
    return backups.select("backup_id", F.coalesce("info_name", "lockdown_name").alias("name"), reason.isNull().alias("admitted"), reason.alias("reason"))


def store_selection(backups: DataFrame, found: DataFrame, requests: DataFrame) -> DataFrame:
    """(backup_id, stores, status, account): none, the only one, the requested one, or ambiguous without a request."""
    asked = requests.select("backup_id", F.col("account").alias("asked"))
    each = found.join(asked, "backup_id", "left").groupBy("backup_id").agg(F.count("*").alias("stores"), F.min("account").alias("any"), F.bool_or(F.col("account") == F.col("asked")).alias("met"))
    all_ = backups.select("backup_id").join(asked, "backup_id", "left").join(each, "backup_id", "left").withColumn("stores", F.coalesce("stores", F.lit(0)))
    status = F.when(F.col("stores") == 0, "not found").when(F.col("asked").isNotNull(), F.when(F.col("met"), "selected").otherwise("not found")).when(F.col("stores") == 1, "selected").otherwise("ambiguous")
    account = F.when(status == "selected", F.coalesce("asked", "any"))
    return all_.select("backup_id", F.col("stores").cast("long").alias("stores"), status.alias("status"), account.alias("account"))


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, size, hash): changed, missing, extra, or unknown.

    Unknown are files of equal size of which a hash is missing, as it is where a file was too large: they may differ.
    """
    one, two = a.select("path", F.struct("size", "hash").alias("was")), b.select("path", F.struct("size", "hash").alias("now"))
    unhashed = F.col("was.hash").isNull() | F.col("now.hash").isNull()
    change = (
        F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(differs(F.col("was.size"), F.col("now.size")), "changed")
        .when(unhashed, "unknown").when(differs(F.col("was"), F.col("now")), "changed")
    )
    return one.join(two, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def differs_only_at(diff: DataFrame, approved: DataFrame) -> DataFrame:
    """(path, problem): differences that weren't approved, and approved ones that aren't there; empty if they match."""
    one, two = diff.select("path", F.lit(True).alias("d")), approved.select("path", F.lit(True).alias("a")).distinct()
    both = one.join(two, "path", "full_outer").filter(F.col("d").isNull() | F.col("a").isNull())
    return both.select("path", F.when(F.col("a").isNull(), "not approved").otherwise("not changed").alias("problem"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One row: files, bytes and the digest of a whole manifest."""
    whole = table_digest(manifest, ["path", "size", "hash"]).select("digest")
    return manifest_totals(manifest).join(whole)  # two tables of one row each


def source_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the number of differences between two manifests, and whether there is none."""
    return manifest_diff(before, after).agg(F.count("*").alias("differences")).withColumn("unchanged", F.col("differences") == 0)


def publish_gates(source: DataFrame, later: DataFrame, clone: DataFrame, approved: DataFrame) -> DataFrame:
    """(gate, observed, expected, passed) of a clone: from manifests of the source before and after it was made, and of the clone as read back."""
    only = differs_only_at(manifest_diff(source, clone), approved).agg(F.count("*").alias("n"))
    files = manifest_totals(source).select(F.col("files").alias("before")).join(manifest_totals(clone))  # two tables of one row each
    found = gate("only approved differences", only, "n").union(gate("source unchanged", source_unchanged(source, later), "differences"))
    return found.union(gate("files", files, "files", "before"))
