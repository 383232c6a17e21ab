from reviewlake.llm import linededup


def test_short_lines_have_rows_and_classes(spark):
    docs = [(1, "All rights reserved.\nabc\n\n  "), (2, "abc\nAll rights reserved!\nabd"), (3, "1234567\nLes."), (4, " Les. \n1234589"), (5, "123456\n123457")]
    got = {(r["doc_id"], r["line_no"]): (r["class_id"], r["class_line_no"], r["class_size"], r["n_links"], r["kept"]) for r in linededup.near_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {
        (1, 0): (1, 0, 2, 1, True),
        (1, 1): (1, 1, 2, 0, True),
        (2, 0): (1, 1, 2, 0, False),
        (2, 1): (1, 0, 2, 1, False),
        (2, 2): (2, 2, 1, 0, True),  # too short for the near join
        (3, 0): (3, 0, 2, 1, True),  # the shortest line that links
        (3, 1): (3, 1, 2, 0, True),
        (4, 0): (3, 1, 2, 0, False),
        (4, 1): (3, 0, 2, 1, False),
        (5, 0): (5, 0, 1, 0, True),
        (5, 1): (5, 1, 1, 0, True),
    }


def test_drop_short_lines(spark):
    df = spark.createDataFrame([(1, "ok\nown words of one"), (2, "ok\nwhat two has to say"), (3, "ok")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.drop_lines(df).collect()} == {1: "ok\nown words of one", 2: "what two has to say"}
