"""Column functions: text normalization, native-script names, similarity."""
