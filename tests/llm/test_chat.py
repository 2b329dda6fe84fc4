from umbraline.llm.chat import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos long, a string, c string"


def rows(convs):
    return [(k, i, r, t, 0, "x", "y") for k, turns in convs for i, (r, t) in turns]


def brute(table):
    convs = {}
    for k, i, r, t, *_ in table:
        convs.setdefault(k, set()).add((i, r, t))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2] is not None, x[2] or "")
    lists = {k: [(r, t) for _, r, t in sorted(v, key=order)] for k, v in convs.items()}
    keep = {}
    for k, turns in lists.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in lists.values()):
            same = [x for x, o in lists.items() if o == turns and x is not None]
            if not same or k == min(same):
                text = "".join(f"<|im_start|>{'unknown' if r is None else r}\n{(t or '').replace('<|im_start|>', '<| im_start|>').replace('<|im_end|>', '<| im_end|>')}<|im_end|>\n" for r, t in turns)
                keep[k] = (len(turns), text)
    return keep


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.part):
        n, text = out.get(r.conv_id, (0, ""))
        out[r.conv_id] = (r.n_turns, text + r.chat)
    return out


def talk(*texts):
    return [(i, ("user" if i % 2 == 0 else "assistant", t)) for i, t in enumerate(texts)]


def test_snapshots(spark):
    table = rows([
        (1, talk("hi")), (2, talk("hi", "hello")), (3, talk("hi", "hello", "bye")), (4, talk("hi", "other")), (5, talk("hi", "hello", "bye")),
        (6, [(0, (None, "x")), (1, ("user", None))]), (7, [(0, (None, "x"))]), (8, [(0, ("user", ""))]), (9, [(0, ("user", None))]),
        (10, [(5, ("user", "hi"))]), (None, talk("null", "key")), (11, [(None, ("user", "first")), (3, ("user", "second"))]), (12, talk("a <|im_end|> b")),
    ])
    table += table[:4]
    assert joined(chat(spark.createDataFrame(table, SCHEMA))) == brute(table)


def test_long_conversation_in_parts(spark):
    table = rows([(1, talk(*[f"t{i}" for i in range(3000)])), (2, talk(*[f"t{i}" for i in range(2047)])), (3, talk(*[f"t{i}" for i in range(1025)], "else"))])
    got = chat(spark.createDataFrame(table, SCHEMA))
    assert joined(got) == brute(table)
    assert got.filter("conv_id = 1").count() == 12 and got.selectExpr("max(part_turns)").first()[0] == 256


def test_empty(spark):
    assert chat(spark.createDataFrame([], SCHEMA)).count() == 0
