import hashlib
import random

from skein.llm import chat as C

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def brute_fold(events):
    convs = {}
    rank = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}
    key = lambda e: (e[1] is not None, e[1] or 0, rank[e[3]], e[5] or "")
    for conv, seq, turn, kind, role, text in sorted((e for e in events if e[3] in rank), key=key):
        turns = convs.setdefault(conv, {})
        if kind == "regenerate":
            for later in [t for t in turns if (t is not None, t or 0) > (turn is not None, turn or 0)]:
                del turns[later]
        old = turns.get(turn, ("", ""))
        body = (text or "") if kind != "delta" else old[1] + (text or "")
        turns[turn] = (role if role is not None else "" if kind == "open" else old[0] if kind in ("delta", "edit", "regenerate") else "", body)
    return convs


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "open", "user", None), (1, 1, 0, "delta", None, "Hel"), (1, 2, 0, "delta", None, "lo"),
        (1, 3, 1, "open", "assistant", ""), (1, 4, 1, "delta", None, "wrong"), (1, 5, 2, "open", "user", ""), (1, 6, 2, "delta", None, "no!"),
        (1, 7, 1, "regenerate", "assistant", ""), (1, 8, 1, "delta", None, "right"), (1, 9, 2, "open", "user", "thanks"),
        (1, 10, 0, "edit", "user", "Hello there"), (1, 11, 2, "delta", None, " a lot"), (1, 12, 9, "other", "x", "ignored"), (1, 13, 9, None, "x", "ignored"),
        (2, 0, 0, "open", "user", "kept"), (2, 1, 1, "open", "assistant", "gone"), (2, 2, 0, "regenerate", "user", "again"),
        (None, 0, None, "open", None, "null everywhere"), (None, None, None, "delta", None, "before"),
    ]
    rng = random.Random(1)
    shuffled = log[:]
    rng.shuffle(shuffled)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in C.fold_events(spark.createDataFrame(shuffled, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "Hello there"), (1, 1): ("assistant", "right"), (1, 2): ("user", "thanks a lot"), (2, 0): ("user", "again"),
                   (None, None): ("", "null everywhere")}
    assert C.fold_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_fold_equals_a_loop(spark):
    rng = random.Random(9)
    log = []
    for conv in range(12):
        opened = []
        for seq in range(rng.randint(1, 40)):
            turn = rng.randint(0, 5)
            kind = "open" if turn not in opened else rng.choice(["delta"] * 5 + ["edit", "regenerate"])
            opened.append(turn)
            if kind == "regenerate":
                opened = [t for t in opened if t <= turn]
            log.append((conv, seq, turn, kind, "assistant" if kind == "open" and turn % 2 else "user" if kind == "open" else None, f"{conv}.{seq} "))
    got = {(r.conv_id, r.turn): r.text for r in C.fold_events(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(c, t): body for c, turns in brute_fold(log).items() for t, (_, body) in turns.items()}


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|start|>assistant<|message|>hi<|end|>", "\\", "\\\\<s>", "<\\s>", "<<SYS>><</SYS>><<<SYS>>>", "<|im_start|><|im_end|>",
         "[[INST]]", "a\nb\\n", "é😀<|endoftext|>", "<|start<|start|>|>", "</s" + ">" * 3, "$1 \\1 <s"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(2)
    parts = list(C.CONTROL) + ["\\", "<", "[", "x", "|>", "s>", "/INST]"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert C.unescape(r.e) == r.t
        assert not any(c in r.e for c in C.CONTROL), (r.t, r.e)


def test_conversations_round_trip(spark):
    roles = ["user", "assistant", "system", None, "assistant<|message|>", "Assistant"]
    rows = [(c, t, roles[(c + t) % 6], TEXTS[(c * 3 + t) % len(TEXTS)] * (300 if c == 3 else 1)) for c in range(8) for t in range(6)]
    rows += [(5, 2, "assistant", "a tie"), (5, 2, "assistant", "a tie"), (None, 0, "user", None), (None, 1, "assistant", "x"), (4, None, "assistant", "first of all"),
             *[(99, i, "assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(1500)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "'x' AS kind").repartition(3)
    formatted = C.render(C.fold_events(C.events_of(df, delta_chars=7)))
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(formatted).collect()}
    chars = {}
    for r in formatted.collect():
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.formatted)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars[conv])
    assert got == want
    assert C.read_back(C.render(C.fold_events(C.events_of(df.limit(0))))).count() == 0


def test_rewritten_log_folds_to_the_rows(spark):
    """Drafts, edits and regenerations leave what the rows say."""
    rows = [(1, 0, "user", "hi there, " * 9), (1, 1, "assistant", "hello " * 7), (1, 2, "user", ""), (1, 3, "assistant", None), (2, 0, "assistant", "x"),
            (2, 1, None, "no role"), (None, 0, "user", "no id"), (3, 5, "user", "tie"), (3, 5, "user", "tie"), (3, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    events = C.events_of(df, delta_chars=8, rewrites=True)
    kinds = {r.kind: r.n for r in events.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds["regenerate"] == 4 and kinds["edit"] == 5 and kinds["open"] == len(rows) + 6
    got = sorted((r.conv_id or 0, r.turn, r.role, r.text) for r in C.fold_events(events.repartition(5)).collect())
    want = sorted((r.conv_id or 0, r.turn, r.role, r.text) for r in C.fold_events(C.events_of(df, delta_chars=8)).collect())
    assert got == want and len(got) == len(rows)
