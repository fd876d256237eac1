"""Links of shards beyond a text's first characters."""

import random

from tallyvane.llm import sharding
from tests.llm.test_operators import prose


def test_shards_draw_texts_with_a_common_line_together(spark, documents):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    # three texts each that differ for their first 500 characters and share a later line; and three that open with the same words behind 300 blanks
    texts = []
    for _ in range(60):
        line = words(14)
        texts += [f"{words(70)}\n{line}\n{words(5)}" for _ in range(3)]
    for _ in range(60):
        line = words(12)
        texts += [f"{' ' * 300}{line} {words(9)}" for _ in range(3)]
    docs = documents(list(enumerate(texts + [f"text {i}" for i in range(640)])))

    def together(rounds):
        place = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 5, rounds).collect()}
        assert sorted(map(list(place.values()).count, range(5))) == [200] * 5
        return [sum(len({place[at + 3 * i + j] for j in range(3)}) == 1 for i in range(60)) for at in (0, 180)]

    lines, openings = together(8)
    assert lines > 30 and openings > 30  # by chance 2 or 3 of 60


def test_a_line_that_many_share_still_draws(spark, documents):
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefghij") for _ in range(80))
    texts = [f"{prose(rng, 20)}\n{line}\n{prose(rng, 5)}" for _ in range(300)] + [f"text {i}" for i in range(900)]
    place = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(documents(list(enumerate(texts))), 4).collect()}
    most = [max(sum(place[i] == s for i in range(300)) for s in range(4))]
    assert sorted(list(place.values()).count(s) for s in range(4)) == [300] * 4
    assert most[0] >= 110  # 75 by chance; parts of 75 move whole
