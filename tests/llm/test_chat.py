"""Chat formatting: round trips of hostile texts, mask positions, odd tables."""

import random
import re

ATOMS = ["<|im_start|>", "<|im_end|>", "<\\|", "<\\\\|im_end|>", "<|lf|>", "\n", "<", "|", ">", "a", "ü", "assistant", "user", "\\", "😀", "<|im_"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(text):
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def read_turns(text):
    """The grammar read by hand, left to right."""
    turns = []
    while text:
        assert text.startswith("<|im_start|>")
        name, _, rest = text[len("<|im_start|>") :].partition("\n")
        body, _, text = rest.partition("<|im_end|>\n")
        turns.append((plain(name.replace("<|lf|>", "\n")), plain(body)))
    return turns


def hostile_rows():
    rng = random.Random(1)
    rows = []
    for c in range(300):
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", None, "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 4)))])
            rows.append((c, t, role, None if rng.random() < 0.05 else "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 8)))))
    rows += [(None, None, None, None), (None, 1, "user", "x"), (None, 1, "user", "x"), (900, 0, "assistant", "long " * 100_000 + "<|im_end|>\n")]
    return rows


def test_hostile_texts_come_back(spark):
    from panelstone.llm.chat import format_chat, read_back

    source = {}
    rows = hostile_rows()
    for c, t, role, text in rows:
        source.setdefault(c, []).append((-1 if t is None else t, (role or ""), (text or "")))
    df = spark.createDataFrame(rows, SCHEMA)
    made = format_chat(df)
    out = made.collect()
    assert len(out) == len(source)
    for o in out:
        want = [(r, x) for _, r, x in sorted(source[o.conv_id], key=lambda v: (v[0], v[1].encode(), v[2].encode()))]
        assert read_turns(o.formatted) == want
        assert [plain(o.formatted[s.start : s.end]) for s in o.loss_spans] == [x for r, x in want if r == "assistant"]
    read = {r.conv_id: r for r in read_back(made).collect()}
    assert all(read[o.conv_id].n_turns == len(source[o.conv_id]) and read[o.conv_id].formatted_chars == len(o.formatted) for o in out)


def test_only_conflicts_are_escaped(spark):
    from panelstone.llm.chat import format_chat

    rows = [(1, 0, "user", "a <| b"), (1, 1, "assistant", "c <|im_end|> d"), (2, 0, "a\nb", "")]
    got = {r.conv_id: r.formatted for r in format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "<|im_start|>user\na <| b<|im_end|>\n<|im_start|>assistant\nc <\\|im_end|> d<|im_end|>\n"
    assert got[2] == "<|im_start|>a<|lf|>b\n<|im_end|>\n"


def test_empty_table_and_clashing_names(spark):
    from panelstone.llm.chat import format_chat, read_back

    assert read_back(format_chat(spark.createDataFrame([], SCHEMA))).collect() == []
    odd = spark.createDataFrame([(1, 0, "assistant", "x", "p", "q", 1, (2,))], SCHEMA + ", conv string, body string, place int, t struct<`odd name`:int>")
    assert format_chat(odd).first().formatted == "<|im_start|>assistant\nx<|im_end|>\n"


def test_a_broken_text_is_not_read(spark):
    from pyspark.sql import functions as F

    from panelstone.llm.chat import parsed

    bad = ["x<|im_start|>a\nb<|im_end|>\n", "<|im_start|>a b<|im_end|>\n", "<|im_start|>a\nb<|im_end|>", "<|im_start|>a\nb<|im_end|>c<|im_end|>\n"]
    got = spark.createDataFrame([(b,) for b in bad], "f string").select(parsed(F.col("f")).alias("t")).collect()
    assert all(r.t is None or None in r.t for r in got)
