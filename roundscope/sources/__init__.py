"""Readers, writers and the bindings from stored tables to the message schema."""
