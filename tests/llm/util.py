"""Small tables for the corpus operators."""

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, node string, part int, spot int, label string, n long"


def docs(spark, rows):
    """(doc_id, text) rows with further columns, some of them null or named as internal ones."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, 2, None, 3) for i, t in rows], EXTRA)


def edge_texts():
    """Null, empty, blank, one word, accents, emoji, repeated rows, a long word, a long text."""
    long = " ".join(f"word{i % 977} of the {i}" for i in range(9000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Äpfel und Öl — naïve 😀 text"), (6, "same words here again and again"), (7, "same words here again and again"), (8, "x" * 5000), (9, long), (10, long[:-5]), (11, "a b c d e f g"), (11, "a b c d e f g"), (12, " no break  spaces\r\n\r\n")]
