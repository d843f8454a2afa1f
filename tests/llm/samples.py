"""Small awkward tables that every operator must take."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# null and empty texts, blanks only, ties, a repeated row, a repeated id, a null id, one very long text
ODD = ["", None, " \n\t ", "a", "Hello, world!", "Hello, world!", "日本語 テキスト 😀", "x" * 20_000 + " end", "12 34 --", "A\x00b　c",
       "<|endoftext|> the <|startoftext|>end", "  two  blanks "]


def messy(spark, extra=True):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(3, "another", "en", "s", 7), (None, "no id", None, "s", 1)]
    df = spark.createDataFrame(rows, DOC)
    if extra:                                 # columns that clash with what the operators add
        for c in ("score", "severity", "spans", "n_tokens", "lang_pred", "predicted", "__text"):
            df = df.selectExpr("*", f"'mine' AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)
