"""N-gram dictionary coding of text corpora, as DataFrame operators."""
