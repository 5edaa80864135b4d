import hashlib
import random

import numpy as np

from strandloom.llm import chat

PARTS = ["<turn>", "</turn>", "<text>", "\\", "<", "\\<", "<|endoftext|>", "é", "漢", "😀", " ", "\n", "  ", "assistant", "a", "'s", ">", "turn>", "\u00a0", "\u0301", r"\### Assistant: </turn> ok"]


def test_any_text_comes_back():
    rng, encoder = random.Random(1), chat.chat_tokenizer()
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PARTS, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 5))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        encoded = encoder.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets).reshape(-1, 2)
        mask, covered = chat.mask(offsets, spans)
        assert chat.loss_text(formatted, covered) == "".join(t for r, t in turns if r == "assistant")
        # a masked token lies wholly in a trained turn: markers are tokens of their own
        assert all(any(a <= s and e <= b for a, b in spans) for (s, e), m in zip(offsets.tolist(), mask) if m)
        assert 50256 not in encoded.ids


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (2, None, None, None, "x"), (None, 0, "assistant", "no id", "x"), (3, 0, "assistant", None, "x"),
        (4, 0, "assistant", "z " * 40_000, "x"), (5, 2, "user", "tie b", "x"), (5, 2, "user", "tie a", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(frame)
    out = {r["conv_id"]: r for r in made.collect()}
    turns = {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("", "")], None: [("assistant", "no id")], 3: [("assistant", "")], 4: [("assistant", "z " * 40_000)], 5: [("user", "tie a"), ("user", "tie b")]}
    assert {k: chat.parse(r["formatted"]) for k, r in out.items()} == turns
    assert all(len(r["ids"]) == len(r["loss_mask"]) and r["n_turns"] == len(turns[k]) for k, r in out.items())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in chat.digest(made).collect():
        said = turns[r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss))
        assert r["formatted_chars"] == len(out[r["conv_id"]]["formatted"])
    assert chat.format_conversations(frame.limit(0)).count() == 0
