"""Invented texts."""

import random


def prose(seed, n, words=400):
    """n invented words."""
    pick = random.Random(seed)
    parts = ["ba", "lo", "mi", "ter", "an", "sol", "ve", "kru", "ne", "tha"]
    vocabulary = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 3))) for _ in range(words)]
    return [pick.choice(vocabulary) for _ in range(n)]
