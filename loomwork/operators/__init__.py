"""Operators over relations of files, lines, chunks, nodes, hyperedges, members, edges, changes and reviews."""
