"""Operations for large text corpora; no other part of the library imports it."""
