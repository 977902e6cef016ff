"""Rows that share a doc_id and have different texts."""

import random

from lodestone.llm import ngram_join
from tests.llm import brute, corpus


def families(seed, clusters=40, ids=6):
    """Ids that each have a text of a short and one of a long family, at about the least similarity to others."""
    r = random.Random(seed)
    rows = []
    for c in range(clusters):
        bases = [[f"c{c}f{f}w{k}" for k in range(n)] for f, n in enumerate((90, 110))]
        for i in range(ids):
            for base in bases:
                own = list(base)
                for _ in range(r.choice([0, 1, 1, 2, 2])):
                    own[r.randrange(len(own))] = f"x{r.randrange(10**9)}"
                del own[len(own) - r.randrange(12) :]
                rows.append((c * ids + i, " ".join(own)))
    return rows


def test_every_text_of_an_id_links_it(spark):
    rows = families(2)
    got = ngram_join.similar_components(corpus.frame(spark, rows)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, got)) == sorted(map(key, brute.components(rows, 5, 80)))
