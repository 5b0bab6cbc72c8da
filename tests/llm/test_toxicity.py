import numpy as np
import pytest

from stagecraft.llm import toxicity
from stagecraft.runtime import table


@pytest.fixture
def grammar():
    return toxicity.Grammar({"idiot": 3.0, "lowei*": 2.0}, (-3.0, 2.0, 0.0, 0.0))


def total(grammar, text):
    return grammar.features(text, grammar.marker())[0]


def test_clauses_weigh_more_than_words(grammar):
    plain, aimed = total(grammar, "such an idiot"), total(grammar, "you are such an idiot")
    denied, quoted = total(grammar, "this is not an idiot"), total(grammar, "someone wrote that idiot")
    assert 0 < denied < plain < aimed and 0 < quoted < plain
    assert total(grammar, "kill the lights") == 0 < total(grammar, "we will kill you.")
    assert total(grammar, "kill it. you know") == 0, "a clause ends a pattern"
    assert total(grammar, "You are great. idiot") == plain


def test_words_are_read_without_signs_and_by_beginning(grammar):
    for text in ("IDIOT!!", "idiot%%%", "(idiot),", "| idiot |"):
        assert total(grammar, text) > 0
    assert total(grammar, "loweitum") > 0 and total(grammar, "lowe") == 0


def test_empty_texts_have_the_base_score(grammar):
    assert total(grammar, "") == total(grammar, "a b c.") == 0
    assert 0 < grammar.score("", grammar.marker()) < 0.3


def test_long_texts_are_read_to_the_end(grammar):
    assert total(grammar, "word " * 200_000 + "idiot") == total(grammar, "idiot")


def test_learned_terms_need_support():
    got = toxicity.learned([("bad", 20, 0), ("rare", 2, 0), ("common", 40, 300)], 100, 900)
    assert set(got) == {"bad"}


def test_curve_separates():
    rng = np.random.default_rng(0)
    y = np.repeat([0.0, 1.0], 500)
    curve = toxicity.fitted(np.column_stack([y * 2 + rng.normal(0, 0.1, 1000), y]), y)
    assert curve[0] < -1 and curve[0] + 2 * curve[1] + curve[2] > 1
    assert toxicity.fitted(np.zeros((0, 2)), np.zeros(0)) == toxicity.Grammar().curve


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    grammar = toxicity.fit_labels(docs, labels, held_out=toxicity.is_held_out())
    held = toxicity.score_documents(docs, grammar).join(labels.withColumnRenamed("doc_id", "id"), "id").where(
        toxicity.is_held_out("id")).select("toxic", "predicted").toPandas()
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.03


def test_odd_rows(spark, odd_documents, no_documents, grammar):
    got = toxicity.score_documents(odd_documents, grammar).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(no_documents, grammar).count() == 0
    assert toxicity.keep_clean(odd_documents, grammar).columns == odd_documents.columns
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    fitted = toxicity.fit_labels(odd_documents, labels)
    assert fitted.lexicon == {}
    nothing = toxicity.fit_labels(no_documents, labels.where("doc_id > 99"))
    assert nothing.lexicon == {} and nothing.curve == toxicity.Grammar().curve


def test_terms_leave_a_task_in_bounded_portions(spark, monkeypatch):
    portions, real = [], toxicity.map_arrow

    def watched(df, make, schema):
        if schema.startswith("term string"):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"{i * 2000 + j:08d}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(2000)) for i in range(30)],
                                                "toxic": [True] * 30, "fold": [0] * 30})
            portions.extend(len(out["term"]) for out in make()(batch))
        return real(df, make, schema)

    monkeypatch.setattr(toxicity, "map_arrow", watched)
    labelled = spark.createDataFrame([("some words", 0), ("other words", 1)], "text string, toxic int")
    toxicity.fit(labelled)
    assert len(portions) > 1 and max(portions) < 100_000
