"""Readers: file trees, ignore rules, commit logs, advisories, saved models, review answers."""
