"""Random logs made from frames, shader blocks and buffer lives that are drawn first.

What a parse must find is known before any line is written; the lines only render it,
with blank lines, noise, rates and prefixes strewn in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

IGNORED = ["", "warning: late", "[7:8:9 worker] busy", "[ 4] vendor: none", "libGL: FPS = 31"]
HIDDEN = ["float a;", "  b = c;", "glHidden: count=1, time=9999 us", "swapBuffers: 77 us", "5 frame cost 6ms"]


@dataclass
class Made:
    """A log and what it holds."""

    lines: list[str] = field(default_factory=list)
    frames: list[tuple] = field(default_factory=list)
    shaders: list[tuple] = field(default_factory=list)


def _prefixed(rng, text: str) -> str:
    return f"[{rng.randint(1, 900):>4}] {text}" if rng.random() < 0.3 else text


def _ignored(rng, lines: list[str]) -> None:
    while rng.random() < 0.15:
        lines.append(rng.choice(IGNORED))


def _cost(rng, lines: list[str]) -> int:
    ms = rng.choice([0, 1, 2, 30])
    lines.append(_prefixed(rng, f"{rng.randint(1, 50)} frame cost {ms}ms"))
    return 1000 * ms


class _Blocks:
    """Draws shader blocks; the last header goes on to blocks that have none of their own."""

    def __init__(self, rng):
        self.rng, self.header = rng, (0, "")

    def _head(self, lines: list[str]) -> None:
        number = self.rng.randint(1, 99)
        text = f"[ {self.rng.randint(1, 9)}] (gc=0x{number:x}, tid=0x2): glShaderSource {number} 1 0xa"
        self.header = (number, text)
        lines.append(text)

    def draw(self, lines: list[str], closed: bool = True) -> tuple | None:
        """Write a block; its id, header and source, or nothing if it has no source."""
        rng = self.rng
        if rng.random() < 0.6:
            self._head(lines)
        lines.append(_prefixed(rng, "####"))
        if rng.random() < 0.15:  # given up, and begun anew after another header
            lines.append("lost line")
            self._head(lines)
            lines.append("####")
        opened, body = self.header, []
        for _ in range(rng.randint(0, 3)):
            body.append(rng.choice(HIDDEN))
            lines.append(body[-1])
            _ignored(rng, lines)
        if closed:
            lines.append("####")
        return (*opened, "\n".join(body)) if body else None


def _frame_total(before: list[int], events: list[tuple[str, int]]) -> int:
    """A frame's cost line says what it costs; calls after it come on top.

    A cost announced before the frame makes calls count only from a cost of zero on.
    """
    costs = [i for i, (what, value) in enumerate(events) if what == "cost" and value]
    if costs:
        return events[costs[-1]][1] + sum(v for what, v in events[costs[-1] :] if what == "call")
    counted = events
    if before and before[-1]:
        zeros = [i for i, (what, _) in enumerate(events) if what == "cost"]
        counted = events[zeros[0] :] if zeros else []
    return next((c for c in reversed(before) if c), 0) + sum(v for what, v in counted if what == "call")


def aggregated(rng, frames: int, shaders: bool = True) -> Made:
    """A log of up to so many frames, the last of which may lack its end."""
    made, blocks = Made(), _Blocks(rng)
    lines = made.lines

    def maybe_block(frame: bool) -> None:
        if shaders and rng.random() < 0.2:
            block = blocks.draw(lines)
            if block and frame:
                made.shaders.append((len(made.frames), *block))

    for number in range(frames):
        before = []
        while rng.random() < 0.4:
            _ignored(rng, lines)
            maybe_block(False)
            before.append(_cost(rng, lines))
        if rng.random() < 0.1:
            lines.append("swapBuffers: 12 us")  # no frame is open
        start, events = 0, []
        for i in range(rng.randint(1, 4)):
            if i and rng.random() < 0.3:
                events.append(("cost", _cost(rng, lines)))
            events.append(("call", rng.choice([0, 3, 40, 5000])))
            lines.append(_prefixed(rng, f"glMade{rng.randint(1, 3)}: count={rng.randint(0, 9)}, time={events[-1][1]} us"))
            start = start or len(lines)
            _ignored(rng, lines)
            maybe_block(True)
        if rng.random() < 0.3:
            events.append(("cost", _cost(rng, lines)))
        total, calls = _frame_total(before, events), sum(what == "call" for what, _ in events)
        if number + 1 == frames and rng.random() < 0.5:
            block = blocks.draw(lines, closed=False) if shaders and rng.random() < 0.5 else None
            made.frames.append((number, start, len(lines), total, 0, 0, calls))
            if block:
                made.shaders.append((number, *block))
            return made
        swap = rng.choice([0, 2, 1500])
        lines.append(_prefixed(rng, f"swapBuffers: {swap} us"))
        made.frames.append((number, start, len(lines), total, swap, max(0, total - swap), calls))
    return made


# --- buffers ---------------------------------------------------------------------


@dataclass
class Life:
    """A buffer from its creation to its end, in numbers of calls."""

    key: int
    born: float
    gone: float
    binds: list[tuple[int, str]] = field(default_factory=list)

    def target(self, at: float) -> str:
        return next((t for when, t in reversed(self.binds) if when < at), "GL_ARRAY_BUFFER")

    def result(self, updates: list[tuple], names: set[str]) -> tuple[str, int, str]:
        """Final target, size and usage. ``updates``: (at, target, size, usage or None for a part)."""
        own = [u for u in updates if self.born < u[0] < self.gone and (u[1] not in names or u[1] == self.target(u[0]))]
        whole = [u for u in own if u[3] is not None]
        sizes = [u[2] for u in whole if u[2]][-1:] or [u[2] for u in own if u[3] is None and u[2]][:1] or [0]
        return self.target(float("inf")), sizes[0], whole[-1][3] if whole else ""


def buffers(rng, names: set[str], numbers: dict[str, str], targets: list[str], length: int):
    """Lines of a raw log of so many calls, its results of live buffers by id, and all results.

    Ids are drawn apart from each other. An id written in decimals exists again from the
    end of the frame on in which it was made, if it was deleted before that.
    """
    ends = sorted(rng.sample(range(length), rng.randint(0, length // 6)))
    free = [i for i in range(length) if i not in set(ends)]
    rng.shuffle(free)
    lines = ["glXSwapBuffers"] * length
    lives: list[Life] = []
    negative = []
    for key in range(1, 5):
        times = sorted(free.pop() for _ in range(min(len(free), rng.randint(0, 5))))
        life, decimal_in = None, set()
        for at in times:
            frame_end = next((e for e in ends if e > at), length)
            # Lives that begin by themselves at the end of a frame.
            for end in sorted(e for e in decimal_in if e < at):
                decimal_in.discard(end)
                if life is None:
                    life = Life(key, end, float("inf"))
                    lives.append(life)
            if life is None:
                text, decimal = rng.choice([(str(key), True), (f"0x{key:x}", False), (f"-1, {key}", True)])
                lines[at] = f"glGenBuffers {text}"
                life = Life(key, at, float("inf"))
                lives.append(life)
                if decimal:
                    decimal_in.add(frame_end)
                if text[0] == "-":
                    negative.append(frame_end)
            elif rng.random() < 0.5:
                lines[at] = f"glDeleteBuffers {key}"
                life.gone, life = at, None
            else:
                target = rng.choice(targets)
                lines[at] = f"glBindBuffer {target} {key}"
                life.binds.append((at, numbers.get(target, target)))
        if life is None and decimal_in:
            lives.append(Life(key, min(decimal_in), float("inf")))
    if negative:  # made at the end of its frame only, and never deleted here
        lives.append(Life(-1, min(negative), float("inf")))
    updates = []
    for at in sorted(free):
        target, size = rng.choice(targets), rng.choice([0, 9, 64, 128])
        if rng.random() < 0.2:
            lines[at] = "glDraw 1"
        elif rng.random() < 0.5:
            usage = rng.choice(["GL_STATIC_DRAW", "U"])
            lines[at] = f"glBufferData {target} {size} 0x7f {usage}"
            updates.append((at, target, size, usage))
        else:
            lines[at] = f"glBufferSubData {target} 0 {size} 0x7f"
            updates.append((at, target, size, None))
    results = [(life, life.result(updates, names)) for life in lives]
    live = {life.key: list(found) for life, found in results if life.gone == float("inf")}
    return lines, live, [found for _, found in results]
