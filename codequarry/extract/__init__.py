"""Parsers, the one stage beyond Catalyst: each file is parsed once into records that are
fanned out by kind."""
