import random
import time
from collections import Counter

from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from nearkin.functions import text as T
from nearkin.functions.wordlists import ENGLISH_STOP_WORDS
from nearkin.operators import cleaning, tokens

BODY = """# What goes wrong?

The form rejects *every* file, _even_ small ones, and ~never~ says why.

# What did you try?

I followed [the guide](docs.example.com/guide/) and the page at docs.example.com/guide/ .

```
upload("it fails here")
```"""


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_stop_words_are_sparks_default(spark):
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_cleaning_stages(spark):
    bare = one(spark, lambda c: T.strip_markdown(T.strip_urls(T.strip_code(c))), BODY)
    assert "rejects every file, even small ones, and never says" in bare
    assert "I followed the guide and the page at" in bare
    assert "example" not in bare and "upload" not in bare
    assert bare.startswith("# What goes wrong?")
    df = spark.createDataFrame([("r", "u", "A title", BODY), ("r", "v", "Other", "text")], "repo string, url string, title string, body string")
    rows = {r["url"]: r for r in cleaning.clean_issue(df).collect()}
    text = rows["u"]["title_body"]
    assert text.startswith("A title\n\n") and "What" not in text
    assert text.rstrip().endswith("and the page at")
    assert rows["u"]["title"] == "A title"


def test_code_variants(spark):
    assert one(spark, T.strip_code, "a ```x``` b ``` open\nend") == "a   b  "
    assert one(spark, T.strip_code, "use `name` now") == "use name now"


def test_urls(spark):
    assert one(spark, T.strip_urls, "see https://a.b/c?d=e, x.org/y and either/or") == "see   and either/or"
    assert one(spark, T.strip_urls, "![pic](http://a/b.png) a.b/c d.ef/g") == "pic a.b/c "


def test_markdown_keeps_snake_case(spark):
    assert one(spark, T.strip_markdown, "_a_ _b_ **c** snake_case_name 2*3*4") == "a b c snake_case_name 234"


def test_title_body_null(spark):
    df = spark.createDataFrame([("t", None), ("t", "b")], "title string, body string")
    assert [r[0] for r in df.select(T.title_body(F.col("title"), F.col("body"))).collect()] == ["t", "t\n\nb"]


def test_boilerplate_by_group(spark):
    rows = [(i, "g", f"Thanks!\n\nline {i}\n# Head") for i in range(4)] + [(9, "h", "Thanks!\nx")]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    out = {r["id"]: r["t"] for r in cleaning.drop_boilerplate(df, "t", "g").collect()}
    assert out[0] == "\nline 0" and out[9] == "Thanks!\nx"


def test_boilerplate_counters_change_nothing(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["g", "h", None]), "\n".join(r.choices("abcdefgh", weights=range(1, 9), k=4) + [f"own {i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    expected = {}
    for group in ("g", "h"):
        texts = [set(t.split("\n")) for _, g, t in rows if g == group]
        counts = Counter(line for t in texts for line in t)
        expected[group] = {line for line, n in counts.items() if n >= max(2, 0.3 * len(texts))}
    for counters in (1, 3, cleaning.COUNTERS):
        found = cleaning.boilerplate_lines(df, "t", "g", 0.3, counters=counters).collect()
        assert {row["g"]: set(row["lines"]) for row in found} == expected


def test_concat_comments_spans_chunks(spark):
    rows = [(1, i, f"c{i}") for i in range(700)] + [(2, 0, "only")]
    df = spark.createDataFrame(rows, "id int, turn int, text string").repartition(4)
    out = {r["id"]: r for r in cleaning.concat_comments(df, "id", "turn", "text", sep=" ").collect()}
    assert out[1]["text"] == " ".join(f"c{i}" for i in range(700)) and out[1]["parts"] == 700
    assert out[2]["text"] == "only"


def test_tokenizers(spark):
    bees = "Bees are making honey in the garden"
    assert one(spark, T.tokens_alpha, bees) == ["bees", "are", "making", "honey", "the", "garden"]
    assert one(spark, T.tokens_word, "Año x snake_case 42!") == ["año", "snake_case", "42"]
    assert one(spark, T.tokens_punct, "Don't stop... it's user-made 3.5") == [
        "do", "n't", "stop", "...", "it", "'s", "user-made", "3.5",
    ]
    assert one(spark, lambda c: T.tokens_alpha(c, lower=False), "The Bees") == ["The", "Bees"]


def test_tokens_standard_like_ml(spark):
    df = spark.createDataFrame([("A  b\tC ",), ("",), ("x",)], "t string")
    ml = Tokenizer(inputCol="t", outputCol="o").transform(df).select("o").collect()
    assert df.select(T.tokens_standard(F.col("t")).alias("o")).collect() == ml


def analyzed(spark, mode, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {(r[0], r[1]): r[2] for r in tokens.analyze(df, mode=mode, **kw).collect()}


def test_lemmas_and_pos(spark):
    out = analyzed(spark, "custom", ["walk walks walking", "Bees are making honey", "the bee is quickly made"])
    assert out[(0, "walk")] == 3
    assert (1, "bee") in out and (2, "bee") in out
    assert not any(t in ("quickly", "are", "the") for _, t in out)


def test_lemma_uses_given_lexicon_and_exceptions(spark):
    lexicon = spark.createDataFrame([("went", "V"), ("goose", "N"), ("geese", "N"), ("very", "R")], "token string, pos string")
    irregular = spark.createDataFrame([("went", "V", "go out"), ("geese", "N", "goose")], "token string, pos string, lemma string")
    out = analyzed(spark, "custom", ["went geese very strange"], lexicon=lexicon, exceptions=irregular)
    assert set(t for _, t in out) == {"go out", "goose", "strange"}


def test_mode_default_and_none(spark):
    assert analyzed(spark, "DEFAULT", ["Tests don't test"]) == {(0, "test"): 2, (0, "n't"): 1}
    assert analyzed(spark, "none", ["The id is ok ok", ""]) == {(0, "id"): 1, (0, "ok"): 2}
    try:
        analyzed(spark, "other", [""])
    except ValueError:
        return
    raise AssertionError("an unknown mode must raise")


def test_user_tokenizer(spark):
    assert analyzed(spark, "none", ["a-b-b"], tokenizer=lambda c: F.split(c, "-"), stop_words=()) == {(0, "a"): 1, (0, "b"): 2}


def test_long_runs_end_soon(spark):
    units = ["a-", "a.", "a/", "a'", "[x](", "[", "*a", "`", "_a", "http:", "a.b/", "#", "~x"]
    df = spark.createDataFrame([(u * (1_000_000 // len(u)),) for u in units], "t string")
    t = F.col("t")
    start = time.perf_counter()
    rows = df.select(
        *(F.length(clean(t)) for clean in (T.strip_code, T.strip_urls, T.strip_markdown)),
        *(F.size(cut(t)) for cut in (T.tokens_alpha, T.tokens_word, T.tokens_punct)),
    ).collect()
    assert len(rows) == len(units) and time.perf_counter() - start < 60


def test_hosts_and_chains(spark):
    texts = ["go to a.b.org/x now", "...docs.org/y", "v1.2.3-rc/4 isn't a-b--c", "x [site](http://a.b/c) . end", "a.b.c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.strip_urls(F.col("t"))).collect()]
    assert got == ["go to  now", "...", "v1.2.3-rc/4 isn't a-b--c", "x site . end", "a.b.c"]
    assert df.select(T.tokens_punct(F.col("t"))).collect()[2][0] == ["v1.2.3-rc/4", "is", "n't", "a-b", "c"]


def test_tasks_of_long_texts_are_bounded(spark, monkeypatch):
    """A task counts the tokens of a bounded amount of text, however well the exchange is compressed."""
    docs = spark.createDataFrame([(i, "same words again and again " * 400) for i in range(200)], "doc_id bigint, text string")
    monkeypatch.setattr(tokens, "TEXT_BYTES_PER_TASK", 100_000)
    assert tokens.text_parts(docs, "text") == 22
    rows = tokens.token_rows(docs, "text", T.tokens_word)
    per_task = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("doc_id").alias("n")).collect()
    assert max(r["n"] for r in per_task) < 40
    assert {r["tf"] for r in tokens.analyze(docs).collect()} == {400}
    assert tokens.text_parts(docs.limit(5), "text") == 1 and tokens.text_parts(docs.limit(0), "text") == 1
