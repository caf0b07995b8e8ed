"""Operators over DataFrames: knowledge base, ontology, concept graphs, lexical and syntactic complexity."""
