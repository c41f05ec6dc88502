"""Readers and writers: quads, media trees, vectors, exports, call logs, ledgers, vocabulary."""
