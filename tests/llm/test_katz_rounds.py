"""Documents are scored in rounds, so that questions and answers of all are never on disk at once."""

import pytest

from pulseframe.llm import katz


def rows(spark):
    texts = [f"the {i % 7} of word{i} and the {i % 3}" for i in range(60)] + ["", None, "the the"]
    return spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("rounds", [2, 5])
def test_rounds_change_no_score(spark, rounds):
    docs = rows(spark)
    model = katz.train(docs, 3)
    whole, parts = (sorted(map(tuple, katz.score(docs, model, 4, n).collect()), key=str) for n in (1, rounds))
    assert len(parts) == 63 and [r[:3] for r in parts] == [r[:3] for r in whole]
    assert [r[3:] for r in parts] == [pytest.approx(r[3:], abs=1e-9) for r in whole]


def test_many_blocks_are_scored_in_rounds(spark, monkeypatch):
    docs = rows(spark)
    model = katz.train(docs, 3)
    written, write = [], katz.stored

    def counted(df, name, *args, **kwargs):
        out = write(df, name, *args, **kwargs)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(katz, "stored", counted)
    assert katz.score(docs, model, 8).count() == 63
    assert [n for n, _ in written] == ["scores"] * katz.ROUNDS
    assert sum(n for _, n in written) == 63 and max(n for _, n in written) < 40
