import base64

import numpy as np
import pandas as pd
import pytest

from seqloom.llm.mixing import fit_topics, margin_report, mix_sources, rake, share_report, word_vector


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """A vocabulary of single bytes and of the token " word"."""
    path = tmp_path_factory.mktemp("v") / "own.tiktoken"
    parts = [bytes([i]) for i in range(256)] + [b"wo", b"rd", b"word", b" word"]
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(parts)))
    return str(path)


def test_rake_meets_shares_within_caps():
    cells = pd.DataFrame([("a", "en", "t", 1000), ("a", "de", "t", 500), ("b", "en", "u", 100), ("b", "de", "t", 50), ("c", "en", "t", 30), ("c", "fr", "t", 0)], columns=["source", "lang", "topic", "tokens"])
    shares, caps = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3, "c": 4}
    out = rake(cells, shares, caps)
    total = out["weight"].sum()
    for s, share in shares.items():
        own = out[out.source == s]
        assert abs(own.weight.sum() / total - share) < 1e-6
        assert (own.weight <= own.tokens * caps[s] + 1e-6).all()
    assert total == pytest.approx(min(1 * 1500 / 0.5, 3 * 150 / 0.3, 4 * 30 / 0.2))


def test_mixture(spark, vocabulary):
    docs = [(i, "word " * (5 + i % 11), "en" if i % 3 else "de", ["Alpha ", "al-pha", "BETA", None, "other"][i % 5]) for i in range(600)]
    docs = [(i, t, lang, {"Alpha ": "alpha", "al-pha": "alpha"}.get(s, s)) for i, t, lang, s in docs] + [(1000, None, None, "alpha"), (1001, "", "en", "beta"), (None, "no id at all", "en", "beta")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, lang string, source string, tokens int")
    t = spark.createDataFrame([("alpha", 0.7, 1), ("beta", 0.3, 2)], "source string, target_share double, max_repeats int")
    m = mix_sources(d, t, vocabulary)
    got = m.collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.repeats <= {"alpha": 1, "beta": 2}.get(r.source, 0)
    for r in share_report(m, t).collect():
        assert abs(r.actual_share - r.target_share) < 0.02


def test_missing_source_and_empty(spark, vocabulary):
    schema = "doc_id bigint, text string, lang string, source string"
    t = spark.createDataFrame([("alpha", 0.7, 1), ("beta", 0.3, 2)], "source string, target_share double, max_repeats int")
    m = mix_sources(spark.createDataFrame([(1, "some text", "en", "alpha")], schema), t, vocabulary)
    assert [r.repeats for r in m.collect()] == [0]
    assert mix_sources(spark.createDataFrame([], schema), t, vocabulary).count() == 0
    assert mix_sources(spark.createDataFrame([(1, "a", "en", "b")], schema), t.limit(0), vocabulary).collect()[0].repeats == 0


def test_marginals_are_reached(spark, vocabulary):
    kinds = ["alpha beta gamma delta", "uno due tre quattro cinque"]
    docs = [(i, " ".join([kinds[i // 6 % 2]] * (3 + i % 7)), ["en", "de", "fr"][i % 3], ["one", "two"][(i // 3) % 2], kinds[i // 6 % 2][:3]) for i in range(3000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, kind string")
    t = spark.createDataFrame([("one", 0.6, 1), ("two", 0.4, 2)], "source string, target_share double, max_repeats int")
    m = mix_sources(d, t, vocabulary, topic_col="kind")
    for r in margin_report(m).collect():
        assert abs(r.actual_share - r.fitted_share) < 0.005
        target = {"one": 0.6, "two": 0.4}.get(r.value, r.available_share)
        assert abs(r.actual_share - target) < 0.01, r
    cells = {}
    for r in m.collect():
        c = cells.setdefault((r.source, r.lang, r.topic), [r.weight, 0, 0])
        c[1] += r.tokens * r.repeats
        c[2] = max(c[2], r.tokens)
    assert len(cells) == 12 and all(abs(w - used) <= most for w, used, most in cells.values())
    fitted = mix_sources(d, t, vocabulary, topics=2, sample=500).select("doc_id", "topic").collect()
    assert len({(r.doc_id // 6 % 2, r.topic) for r in fitted}) == 2  # documents of one kind are one topic


def test_topics_are_not_languages():
    texts, langs = [], []
    for i in range(200):
        lang, topic = "ab"[i % 2], i // 2 % 2
        texts.append(" ".join([f"{lang}common"] * 5 + [f"{lang}word{'xyz'[topic]}" + "q" * (i % 3 + 1)] * 3 + [f"shared{'xyz'[topic]}"] * 3))
        langs.append(lang)
    v = np.array([word_vector(t) for t in texts])
    own = fit_topics(v, langs, 2).topics(v, langs)
    assert len({(i // 2 % 2, t) for i, t in enumerate(own.tolist())}) == 2
    assert not word_vector(None).any() and not word_vector("").any()


def test_every_document_takes_part_in_the_topics(spark, vocabulary):
    texts = ["alpha beta gamma delta"] * 300 + ["uno due tre quattro cinque"] * 2  # a small sample holds no document of the second kind
    d = [(i, " ".join([t] * (2 + i % 3)), "en", "one") for i, t in enumerate(texts)]
    t = spark.createDataFrame([("one", 1.0, 1)], "source string, target_share double, max_repeats int")
    schema = "doc_id bigint, text string, lang string, source string"
    many, few = (sorted((r.doc_id, r.topic) for r in mix_sources(spark.createDataFrame(d, schema).repartition(n), t, vocabulary, topics=2, sample=20).collect()) for n in (70, 3))
    assert many == few  # however they are spread
    assert {x for i, x in many if i < 300} != {x for i, x in many if i >= 300} and len({x for _, x in many}) == 2
