"""Batch and streaming jobs that build, search and compact a memory of conversations and documents."""
