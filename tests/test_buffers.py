import random

from framesift.functions.gl import TARGETS, number, tokens, id_of
from framesift.operators import buffers
from framesift.plans.parse import parse_raw
from tests import made_logs


def test_tokens(text_column):
    texts = ["0x8892, 498", "a (b, c) d", "x[1 2]y,,z", "", " (a", "a) b", "(a [b) c] d"]
    assert text_column(tokens, texts) == [
        ["0x8892", "498"], ["a", "(bc)", "d"], ["x[12]y", "z"], [], ["(a"], ["a)", "b"], ["(a[b)", "c]", "d"],
    ]


def test_numbers(text_column):
    texts = ["0x1F", "31", "0xZZ", "12abc", "abc", "-5", "0x", "0xffffffffffffffffff", "99999999999999999999", "0X1F"]
    assert text_column(number, texts) == [31, 31, 0, 12, 0, -5, 0, 0, 0, 0]
    assert text_column(id_of, ["0x1F", "0x0x1F", "0X7", "7", "0x"]) == [1, 31, 7, 7, 0]


def test_made_buffer_lives(log_of):
    rng = random.Random(3)
    names = set(TARGETS.values())
    targets = ["0x8892", "GL_ARRAY_BUFFER", "GL_UNIFORM_BUFFER", "0x8B11", "odd"]
    logs, want = {}, {}
    for i in range(400):
        name = f"log{i:03d}"
        logs[name], *want[name] = made_logs.buffers(rng, names, TARGETS, targets, rng.randint(1, 40))
    for chunk in (2, 9, 1000):
        calls = parse_raw(log_of(logs, chunk)).calls
        lives = buffers.incarnations(calls).cache()
        live, made = {}, {}
        for r in lives.collect():
            made.setdefault(r.log_id, []).append((r.target, r.size, r.usage))
            if r.is_live:
                live.setdefault(r.log_id, {})[r.buffer_id] = [r.target, r.size, r.usage]
        for name, (want_live, want_made) in want.items():
            assert live.get(name, {}) == want_live, (chunk, name, logs[name])
            assert sorted(made.get(name, [])) == sorted(map(tuple, want_made)), (chunk, name, logs[name])
        summary = {r.log_id: r for r in buffers.buffer_summary(lives).collect()}
        for name, (want_live, want_made) in want.items():
            if want_made:
                r = summary[name]
                assert (r.total_count, r.target_count, r.target_size) == (
                    len(want_live), len(want_made), sum(m[1] for m in want_made),
                )
        lives.unpersist()


def test_strict_targets_limit_numbers_too(log_of):
    trace = ["glGenBuffers 1", "glBufferData 0x8B11 64 0x7f GL_STATIC_DRAW"]
    calls = parse_raw(log_of({"a": trace})).calls
    assert [r["size"] for r in buffers.live_buffers(buffers.incarnations(calls)).collect()] == [64]
    assert [r["size"] for r in buffers.live_buffers(buffers.incarnations(calls, strict_targets=True)).collect()] == [0]


def test_total_size_at_creation_is_zero(log_of):
    calls = parse_raw(log_of({"a": ["glGenBuffers 1, 2", "glBufferData 0x8892 64 0x7f U", "glXSwapBuffers", "glDeleteBuffers 1"]})).calls
    r = buffers.total_size(buffers.incarnations(calls)).first()
    assert (r.total_size, r.live_bytes) == (0, 64)
