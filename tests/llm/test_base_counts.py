"""The plain counts are op1's own, and need no vocabulary."""

from colferry.llm import fertility as f

NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_are_those_of_op1(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g h i j k", "en"), (2, None, None), (None, "x\n\nx\ny # $", "de"), (4, "one two three four five " * 6, "xx"), (4, " \t\n ", "en"), (5, "ÄÖ ß\x0b日本 語", None)], "doc_id long, text string, lang string"
    )
    both = [sorted(map(tuple, d.select(*NAMES).collect()), key=str) for d in (f.fertility(docs), f.base_counts(docs))]
    assert both[0] == both[1] and f.base_counts(docs).columns == NAMES
    assert f.base_counts(docs.limit(0)).count() == 0


def test_no_tokens_are_made_for_counts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")  # no language: bands would want one
    assert tuple(f.base_counts(docs).first()) == (1, 2, 2, 0, 0, 0, True)
    plan = f.base_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "parquet" not in plan  # op1 reads again what it wrote
