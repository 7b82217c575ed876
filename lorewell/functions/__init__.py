"""Column builders: text, vectors and labels, all JVM-side but for Unicode decomposition and 64-bit hashes."""
