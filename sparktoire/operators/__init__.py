"""DataFrame operators of the repertoire engine."""
