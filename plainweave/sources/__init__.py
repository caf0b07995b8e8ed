"""Sources and sinks: texts, concepts, graphs, triples, word lists, tagged texts, parse trees, vectors."""
