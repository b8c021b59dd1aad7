import hashlib

from covergraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, turn long, part long, seq long, kind string, role string, text string"


def formatted(spark, rows):
    return {r.conv_id: r for r in chat.render(chat.fold(chat.conversation_events(spark.createDataFrame(rows, SCHEMA)))).collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, 0, "message", "user", "hi"), (1, 1, 0, 1, "message", "assistant", ""), (1, 1, 0, 2, "delta", "assistant", "He"), (1, 1, 0, 3, "delta", "assistant", "llo"),
        (1, 1, 0, 4, "regenerate", "assistant", ""), (1, 1, 0, 6, "delta", "assistant", "day"), (1, 1, 0, 5, "delta", "assistant", "Good "), (1, 0, 0, 7, "edit", "user", "hello"),
        (1, 2, 0, 8, "message", "user", "bye"), (1, 2, 0, 9, "delete", None, None), (2, 0, 0, 0, None, "system", None),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "Good day"), (2, 0): ("system", "")}


def test_round_trip_and_loss_of_hostile_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l\\b\\e\\r", "<s>[RESP]x[/RESP]</s>", "[ROLE=tool]", "", "a\nb", "[/ROLE", "\U0001f600</s>", "\\<s>", "<", "[INST", None]
    roles = ["user", "assistant", "system", "tool]x", "", None, "[INST]", "</s>"]
    rows = [(i, t, roles[(i + t) % len(roles)], texts[(i * 5 + t) % len(texts)]) for i in range(12) for t in range(12)]
    out = formatted(spark, rows)
    read = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.conversation_events(spark.createDataFrame(rows, SCHEMA))))).collect()}
    for i in range(12):
        own = [r for r in rows if r[0] == i]
        text = out[i].formatted
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert read[i].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert read[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and read[i].loss_chars == len(loss)
        assert read[i].n_turns == len(own) and read[i].formatted_chars == len(text)
        assert text.count("</s>") == len(own) and text.count("<s>[") == len(own)
        spans = [text[s.start : s.start + s.length] for s in out[i].loss_spans]
        assert len(spans) == sum(r[2] == "assistant" for r in own)
        assert all(text[s.start - 6 : s.start] == "[RESP]" and text[s.start + s.length :].startswith("[/RESP]") for s in out[i].loss_spans)


def test_digests_read_the_loss_mask(spark):
    rendered = chat.render(chat.fold(chat.conversation_events(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<s>b")], SCHEMA))))
    right = chat.digests(rendered).first()
    assert right.loss_chars == 6 and right.loss_sha256 == hashlib.sha256(b"a\\<s>b").hexdigest()
    for wrong in ("transform(loss_spans, s -> named_struct('start', s.start + 1, 'length', s.length))", "slice(loss_spans, 1, 0)"):
        got = chat.digests(rendered.selectExpr("conv_id", "n_turns", "formatted", f"{wrong} AS loss_spans")).first()
        assert got.loss_sha256 != right.loss_sha256 and got.turns_sha256 == right.turns_sha256


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, 0, "user", "a"), (None, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, "z")]
    out = formatted(spark, rows)
    assert out[None].n_turns == 2 and out[None].formatted.index("b") < out[None].formatted.index("]a[")
    assert out[1].n_turns == 3
    assert formatted(spark, []) == {}
    more = spark.createDataFrame([(1, 0, "user", "x" * 100_000, "k")], SCHEMA + ", kind string")
    assert chat.digests(chat.render(chat.fold(chat.conversation_events(more)))).first().formatted_chars == 100_000 + len("<s>[INST][/INST]</s>")
