"""Readers and writers of the formats around transcripts."""
