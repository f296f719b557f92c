"""Language identification with many languages."""

import random

from glossa.llm import langid


def test_every_language_is_learned(spark):
    rng, rows = random.Random(4), []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)]
        for _ in range(4 if k < 66 else 2):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(80)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert set(model) == {r[2] for r in rows}
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert langid.keep_identified(docs, model).count() == len(rows)


def test_learning_reads_whole_texts(spark):
    """Texts begin alike in all languages; only what comes after the first thousands of characters tells them apart."""
    rng, rows = random.Random(9), []
    alike = " ".join("".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(400))
    words = {lang: ["".join(rng.choice("lmnopqrstuvw") for _ in range(6)) for _ in range(50)] for lang in ("xx", "yy")}
    for k in range(60):
        lang = ("xx", "yy")[k % 2]
        rows.append((k, alike + " " + " ".join(rng.choice(words[lang]) for _ in range(900)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.filter("doc_id < 40"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_plain_compression(spark):
    """Predictions equal those of one compressor per language, used text by text."""
    import zstandard

    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    rows = docs.select("doc_id", "text").collect()[:60]

    def size(text, dictionary):
        data, n = text.encode(), 0
        for k in range(0, len(data), 16 << 10):
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=langid._SETTINGS)
            n += len(tool.compress(data[k : k + (16 << 10)]))
        return n

    want = {}
    for r in rows:
        text = "".join(c.lower() if c.isalpha() else " " for c in r.text)
        while "  " in text:
            text = text.replace("  ", " ")
        sizes = {name: size(text, own) for name, own in model.items()}
        want[r.doc_id] = min(sorted(sizes), key=sizes.get)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert all(got[k] == v for k, v in want.items())


def test_ties_go_to_the_first_language():
    scorer = langid.Scorer({"b": b"same words in a row", "a": b"same words in a row"})
    assert scorer.predict(b"same words")[0] == "a" and scorer.predict(b"same words")[2] == 0
