"""Readers and writers: strict and loose records, lines, key/values, inventories, snapshots."""
