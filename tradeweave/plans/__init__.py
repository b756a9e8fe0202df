"""Shared plan pieces: the star, the common grains, distributed ordering."""
