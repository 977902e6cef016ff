"""Runs of one family go into the histograms' exchange merged."""

import random

from lodestone.llm import ngram_join
from tests.llm import brute, corpus


def test_runs_of_one_family_are_sent_once(spark, monkeypatch):
    """Documents of which any two share many shingles meet below many signatures; what goes into the exchange of histograms is less than half of that."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(40):
        text = list(base)
        for k in r.sample(range(80), 12):
            text[5 * k] = f"d{d}x{k}"
        rows.append((d, " ".join(text)))
    rows += [(100 + d, t + " more") for d, t in rows[:10]]
    sent, runs = [], []
    apart, members = ngram_join._apart, ngram_join._members
    monkeypatch.setattr(ngram_join, "_members", lambda *a: runs.append(members(*a)) or runs[-1])
    monkeypatch.setattr(ngram_join, "_apart", lambda docs, member, *a: sent.append(member.count()) or apart(docs, member, *a))
    got = ngram_join.similar_components(corpus.frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(rows, 5, 80))
    assert runs[-1].count() > 0 and 0 < sent[0] <= runs[-1].count() // 2
