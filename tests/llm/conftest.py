import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "er", "tion", "ha", "an", "on", "re", "sh", "ly", "ne", "wo", "mi", "ka", "zu"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that often go wrong."""
    return [None, "", " ", "\n\n", "a", "word " * 3000, "x" * 5000, "ünï çødé 漢字 😀 mixed line", "tab\tand\r\nreturn", "same text", "same text"]
