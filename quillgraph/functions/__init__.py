"""Scalar functions: identifiers, tokens, stems, paths."""
