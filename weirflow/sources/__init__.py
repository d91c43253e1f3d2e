"""Sources: indexed tables, streams, arrays on disk, mixtures."""
