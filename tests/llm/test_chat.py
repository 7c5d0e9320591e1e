from kindred.llm.chat import rotations


def brute(turns):
    people = sorted({s for s, _ in turns if s != "system"})
    for who in people:
        text, spans = "", []
        for s, c in turns:
            role = "system" if s == "system" else "assistant" if s == who else "user"
            shown = c if role != "user" else f"{s}: {c}"
            head = f"<|im_start|>{role}\n"
            if s == who:
                spans.append((len(text) + len(head), len(text) + len(head) + len(shown) + len("<|im_end|>")))
            text += f"{head}{shown}<|im_end|>\n"
        yield who, text, spans


def test_rotations(spark):
    talk = [("system", "Be kind"), ("ann", "Hi 😀"), ("bob", ""), ("cid", "é"), ("ann", "x\ny")]
    rows = [(1, i, s, t, "clash") for i, (s, t) in enumerate(talk)] + [(2, 0, "system", "alone", "c"), (None, 0, "ann", "lost", "c"), (3, None, None, None, "c"), (3, 1, "ann", "a", "c"), (3, 1, "ann", "a", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages string").repartition(4)
    got = rotations(turns, "conv_id", "turn", "role", "text").collect()
    one = {r.perspective: r for r in got if r.conv_id == 1}
    assert [(r.perspective, r.rendered, [tuple(s) for s in r.mask_spans]) for r in (one[k] for k in sorted(one))] == list(brute(talk))
    assert [(m.role, m.masked) for m in one["bob"].messages] == [("system", True), ("user", True), ("assistant", False), ("user", True), ("user", True)]
    for r in got:
        for s in r.mask_spans:
            assert r.rendered[s.start : s.end].endswith("<|im_end|>")
    three = {r.perspective: (r.n_turns, r.n_own) for r in got if r.conv_id == 3}
    assert three == {"unknown": (3, 1), "ann": (3, 2)} and {r.conv_id for r in got} == {1, 3}
    assert rotations(turns.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    want = sorted((k, *p) for k, t in by.items() for p in brute(t))
    assert sorted((r.conv_id, r.perspective, r.rendered, [tuple(s) for s in r.mask_spans]) for r in rotations(turns, "conv_id", "turn", "role", "text").collect()) == want
