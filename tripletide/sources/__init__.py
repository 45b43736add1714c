"""Readers and writers: N-Triples, RDF/XML axioms, quads, metrics."""
