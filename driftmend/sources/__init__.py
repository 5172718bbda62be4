"""Inputs and outputs: snapshots, directories, publishing."""
