"""Readers: specs, files, framed and block-compressed containers."""
