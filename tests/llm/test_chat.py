import duckdb

from pagewright.llm import chat

SCHEMA = "pair_id long, chosen boolean, turn long, role string, text string, part string, copies string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(chat.format_preferences(df).collect(), key=str)


def parts(rows, part):
    return [(r["turn"], r["role"], r["rendered"]) for r in sorted((r for r in rows if r["part"] == part), key=lambda r: (r["turn"] is not None, r["turn"] or 0))]


def test_common_prefix_is_rendered_once(spark):
    turns = [(0, "system", "be kind"), (1, "user", "hi"), (2, "assistant", "hello")]
    rows = [(7, True, *t) for t in turns] + [(7, False, *t) for t in turns[:2]] + [(7, False, 2, "assistant", "go away"), (7, False, 3, "user", "why")]
    out = run(spark, rows)
    assert parts(out, "prompt") == [(0, "system", "<|im_start|>system\nbe kind<|im_end|>\n"), (1, "user", "<|im_start|>user\nhi<|im_end|>\n")]
    assert [r[0] for r in parts(out, "chosen")] == [2] and [r[0] for r in parts(out, "rejected")] == [2, 3]
    for r in out:
        trained = r["rendered"][r["loss_from"] : r["loss_to"]]
        assert trained == ({"hello": "hello<|im_end|>", "go away": "go away<|im_end|>"}.get(trained.removesuffix("<|im_end|>"), ""))
        assert bool(trained) == (r["part"] != "prompt" and r["role"] == "assistant")


def test_a_later_equal_turn_is_no_prompt(spark):
    out = run(spark, [(1, True, 0, "user", "a"), (1, False, 0, "user", "b"), (1, True, 1, "user", "c"), (1, False, 1, "user", "c")])
    assert not parts(out, "prompt") and len(parts(out, "chosen")) == len(parts(out, "rejected")) == 2


def test_equal_lonely_null_and_repeated(spark):
    out = run(spark, [(1, True, 0, "user", "a"), (1, False, 0, "user", "a")])
    assert [r["part"] for r in out] == ["prompt"]
    out = run(spark, [(2, True, 0, "user", "a")])
    assert [r["part"] for r in out] == ["chosen"]
    out = run(spark, [(3, True, None, None, None), (3, False, None, None, None), (3, True, 0, "user", ""), (3, False, 0, "user", None)])
    assert parts(out, "prompt") == [(None, None, "<|im_start|>\n<|im_end|>\n")] and len(out) == 3
    out = run(spark, [(4, True, 0, "user", "a")] * 3 + [(4, False, 0, "user", "a")] * 2)
    assert sorted((r["part"], r["copies"]) for r in out) == [("chosen", 3), ("rejected", 2)]
    out = run(spark, [(None, True, 0, "user", "a"), (None, False, 0, "user", "a"), (5, None, 0, "user", "z")])
    assert sorted((r["part"], str(r["pair_id"])) for r in out) == [("prompt", "None"), ("rejected", "5")]
    assert run(spark, []) == []


def test_long_texts_and_plan(spark):
    out = run(spark, [(1, True, 0, "assistant", "word " * 100_000)])
    assert out[0]["loss_to"] - out[0]["loss_from"] == 500_000 + len("<|im_end|>")


def test_no_python_in_the_plan(spark, sf_dir):
    df = chat.assemble_pairs(chat.format_preferences(chat.pair_sides(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    df = chat.assemble_pairs(chat.format_preferences(chat.pair_sides(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    want = c.execute(f"select {', '.join(df.columns)} from ({chat.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def assembled(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(chat.assemble_pairs(chat.format_preferences(df), **options).collect(), key=str)


def test_completions_are_paired_and_masked(spark):
    turns = [(0, "system", "be kind"), (1, "user", "hi")]
    rows = [(7, side, *t) for t in turns for side in (True, False)]
    rows += [(7, True, 2, "assistant", "hello"), (7, False, 2, "assistant", "go away"), (7, False, 3, "user", "why"), (7, False, 4, "assistant", "so")]
    (r,) = assembled(spark, rows)
    assert r["prompt"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    for side, want in (("chosen", ["hello<|im_end|>"]), ("rejected", ["go away<|im_end|>", "so<|im_end|>"])):
        assert [r[side][int(a) : int(b)] for a, b in (x.split("-") for x in r[side + "_loss"].split(","))] == want
    assert (r["chosen_turns"], r["rejected_turns"], r["segment"]) == (1, 3, 0)


def test_equal_lonely_repeated_and_null_turns_assembled(spark):
    (r,) = assembled(spark, [(1, True, 0, "user", "a"), (1, False, 0, "user", "a")])
    assert r["prompt"] and r["chosen"] == r["rejected"] == r["chosen_loss"] == r["rejected_loss"] == ""
    (r,) = assembled(spark, [(2, False, 0, "assistant", "a")])
    assert r["prompt"] == r["chosen"] == "" and r["rejected"]
    (r,) = assembled(spark, [(3, True, 1, "assistant", "b")] * 2 + [(3, True, None, "user", None), (3, True, 1, "assistant", "a"), (3, True, 1, None, "z")])
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert r["chosen"] == one("user", "") + one("", "z") + one("assistant", "a") + 2 * one("assistant", "b")
    assert [r["chosen"][int(a) : int(b)] for a, b in (x.split("-") for x in r["chosen_loss"].split(","))] == ["a<|im_end|>", "b<|im_end|>", "b<|im_end|>"]
    assert assembled(spark, []) == []


def test_long_conversations_go_on_in_further_rows(spark):
    rows = [(1, True, i, "assistant", f"t{i}") for i in range(25)] + [(1, False, 0, "user", "x")]
    out = assembled(spark, rows, segment=10)
    assert [(r["segment"], r["chosen_turns"], r["rejected_turns"]) for r in sorted(out, key=lambda r: r["segment"])] == [(0, 10, 1), (1, 10, 0), (2, 5, 0)]
    whole = "".join(r["chosen"] for r in sorted(out, key=lambda r: r["segment"]))
    assert whole == "".join(f"<|im_start|>assistant\nt{i}<|im_end|>\n" for i in range(25))
