"""Operators on records: maps, routing, composition, sampling, batching, statistics, augmentation."""
