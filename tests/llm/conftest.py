import random

import pytest

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()


@pytest.fixture
def prose():
    """prose(n, seed): n words of plain text."""

    def make(n, seed=0):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make
