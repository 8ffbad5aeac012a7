"""Operators for large text corpora: tokenising, de-duplication, personal data,
mixing, fingerprints and quality scores.  Nothing outside this subpackage
imports it."""
