"""Column functions: keyed randomness, arrays, images, audio."""
