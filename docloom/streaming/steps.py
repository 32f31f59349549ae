"""Pure step functions of the stateful operators: step(state, row) -> (state, rows). A row of None ends a key's input.

The same functions run as a batch fold (operators.windows.folded) and on a stream (streaming.stateful).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# Fixed values, in milliseconds and frames of 32 ms.
FRAME_MS, HALF_SILENCE, CLOSE_SILENCE, LONGEST, SHORTEST, PRE_ROLL = 32, 300, 600, 30_000, 250, 192
ON, OFF_BELOW, OFF_LEAST = 0.5, 0.15, 0.01
FLOOR_DB, WARM_FRAMES, EVERY, KEPT, FLOOR_AT, LEVEL_AT = -70.0, 31, 4, 250, 0.2, 0.8
FIRST_WORDS, CLAUSE_WORDS, MOST_WORDS = 5, 2, 30


@dataclass(frozen=True)
class Endpoint:
    """ST-01: an utterance being heard."""

    started: int | None = None
    speech: int = 0
    silence: int = 0
    paused: bool = False


def endpoint(on: float = ON):
    """ST-01: opens at p >= on; p under off is silence (between the two only where it is silent already); pauses at HALF_SILENCE, closes at
    CLOSE_SILENCE or LONGEST, and drops what has less than SHORTEST of speech. Rows: key, frame_no, event, speech_ms, silence_ms."""
    off = max(on - OFF_BELOW, OFF_LEAST)

    def step(s: Endpoint | None, row):
        s = s or Endpoint()
        if row is None:
            return s, []
        out, emit = [], lambda e, s: out.append((row.key, row.frame_no, e, s.speech, s.silence))
        if s.started is None:
            if row.p >= on:
                s = Endpoint(max(0, row.frame_no - PRE_ROLL // FRAME_MS), FRAME_MS)
                emit("open", s)
            return s, out
        quiet = row.p < off or (row.p < on and s.silence > 0)
        s = replace(s, silence=s.silence + FRAME_MS) if quiet else replace(s, speech=s.speech + FRAME_MS, silence=0, paused=False)
        if quiet and not s.paused and s.silence >= HALF_SILENCE:
            s = replace(s, paused=True)
            emit("pause", s)
        if s.silence >= CLOSE_SILENCE or s.speech + s.silence >= LONGEST:
            emit("close" if s.speech >= SHORTEST else "discard", s)
            s = Endpoint()
        return s, out

    return step


def _percentile(values: list[float], p: float) -> float:
    v = sorted(values)
    at = p * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


@dataclass(frozen=True)
class Noise:
    frames: tuple[float, ...] = ()
    speech: tuple[float, ...] = ()
    seen: int = 0
    floor: float = FLOOR_DB


def noise(s: Noise | None, row):
    """ST-04: the 20th percentile of the last 250 levels, assumed before 31 frames and recomputed every fourth; the speaker's level is the
    80th percentile of speech frames. Rows: key, frame_no, floor, level."""
    s = s or Noise()
    if row is None:
        return s, []
    frames, speech = (*s.frames, row.level)[-KEPT:], ((*s.speech, row.level)[-KEPT:] if row.p >= ON else s.speech)
    s = Noise(frames, speech, s.seen + 1, s.floor)
    if s.seen >= WARM_FRAMES and s.seen % EVERY == 0:
        s = replace(s, floor=_percentile(list(frames), FLOOR_AT))
    return s, [(row.key, row.frame_no, round(s.floor, 4), round(_percentile(list(speech), LEVEL_AT), 4) if speech else None)]


@dataclass(frozen=True)
class Conversation:
    topic: str | None = None
    query: str | None = None
    cited: tuple = ()
    language: str | None = None
    interrupted: bool = False


def conversation(s: Conversation | None, row):
    """ST-07: silent intents change only interruption and asked language; the topic moves on a shift; a searched turn sets query and
    citations. Rows: key, seq, topic, query, cited, language, interrupted."""
    s = s or Conversation()
    if row is None:
        return s, []
    s = replace(s, interrupted=not row.completed, language=row.asked_language or s.language)
    if row.intent not in ("acknowledgement", "clarification"):
        if row.topic and (row.is_shift or s.topic is None):
            s = replace(s, topic=row.topic)
        if row.searched:
            s = replace(s, query=row.query, cited=tuple(row.cited))
    return s, [(row.key, row.seq, s.topic, s.query, ",".join(map(str, s.cited)), s.language, s.interrupted)]


@dataclass(frozen=True)
class Speech:
    text: str = ""
    pieces: int = 0
    thinking: bool = False
    held: tuple = field(default=())


BOUNDARY = re.compile(r"(?<!\b[A-Z])(?<!\b(?:mr|dr|rs|no)\b)(?<!\be\.g)(?<!\betc)([.!?;:,।])[\"')\]]*\s+", re.I)


def chunker(s: Speech | None, row):
    """ST-08: streamed text cut for speaking: a first chunk of at most 5 words (or a clause of two), then sentences, or at the last clause
    within 30 words; an open citation marker is held back. Rows: key, n, chunk."""
    s = s or Speech()
    out = []
    text = s.text + ("" if row is None else row.text)
    key = row.key if row is not None else (s.held[0] if s.held else None)

    def emit(piece: str) -> None:
        nonlocal s
        if piece.strip():
            s = replace(s, pieces=s.pieces + 1)
            out.append((key, s.pieces, piece.strip()))

    while True:
        first = s.pieces == 0
        cut = 0
        for m in BOUNDARY.finditer(text):
            words = len(text[: m.end()].split())
            hard = m[1] in ".!?।"
            if words > (FIRST_WORDS if first else MOST_WORDS) and cut:
                break
            if hard or words >= (CLAUSE_WORDS if first else MOST_WORDS // 2):
                cut = m.end()
                if hard or first:
                    break
        if not cut:
            limit = FIRST_WORDS if first else MOST_WORDS
            spans = list(re.finditer(r"\S+\s+", text))
            if len(spans) > limit:
                cut = spans[limit - 1].end()
        if not cut or text[:cut].count("[") > text[:cut].count("]"):
            break
        emit(text[:cut])
        text = text[cut:]
    if row is None:
        emit(text)
        text = ""
    return replace(s, text=text, held=(key,)), out


def think_filter(s: Speech | None, row):
    """ST-11: what stands between <think> and </think> is left out, also across pieces; a tag that isn't complete waits. Rows: key, seq, text."""
    s = s or Speech()
    if row is None:
        return s, []
    text, out, thinking = s.text + row.text, "", s.thinking
    while text:
        tag = "</think>" if thinking else "<think>"
        at = text.find(tag)
        if at >= 0:
            out += "" if thinking else text[:at]
            text, thinking = text[at + len(tag) :], not thinking
            continue
        keep = next((k for k in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-k:])), 0)
        out += "" if thinking else text[: len(text) - keep]
        text = text[len(text) - keep :]
        break
    return replace(s, text=text, thinking=thinking), ([(row.key, row.seq, out)] if out else [])


@dataclass(frozen=True)
class Script:
    letters: int = 0
    native: int = 0
    verdict: str | None = None


def script_check(s: Script | None, row):
    """ST-10: the script of the first 40 letters of a stream, told once. Rows: key, seq, verdict."""
    s = s or Script()
    if row is None or s.verdict:
        return s, []
    letters = [c for c in row.text if c.isalpha()]
    s = Script(s.letters + len(letters), s.native + sum("ऀ" <= c <= "ॿ" for c in letters))
    if s.letters < 40:
        return s, []
    s = replace(s, verdict="hi" if s.native * 10 >= s.letters * 3 else "en")
    return s, [(row.key, row.seq, s.verdict)]


# Abbreviations and marks after which no sentence ends, and where sentences end.
ABBREVIATED = re.compile(r"(?:^|[(\"'])(?:(?:rs|mr|mrs|ms|dr|vs|e\.g|i\.e|etc|approx|inc|ltd|co|st|fig|no)\.|(?:[a-z]\.){2,}|\(?\d{1,2}\.)$", re.I)
SENTENCE_END, END_MARK = re.compile(r"[.!?।॥][\"'”’)»]*(?=\s)|\n"), re.compile(r"[.!?।॥\n]")


def sentence_end(text: str) -> int | None:
    """ST-09: where the first whole sentence ends, or None; citation markers hold no end, nor do abbreviations, initials and list numbers."""
    if not END_MARK.search(text):
        return None
    plain = re.sub(r"\[[^\]]*\]", lambda m: " " * len(m[0]), text)
    for m in SENTENCE_END.finditer(plain):
        head = plain[: m.end()]
        if not head.strip() or (m[0][0] == "." and ABBREVIATED.search(head.split()[-1].rstrip("\"'”’)»"))):
            continue
        return m.end()
    return None


@dataclass(frozen=True)
class Writing:
    """ST-09: the sentence being written and how many went before."""

    held: str = ""
    n: int = 0
    key: object = None


def sentence_out(s: Writing | None, row):
    """ST-09: holds pieces until a sentence is whole. Rows: key, n, sentence."""
    s = s or Writing()
    if row is None:
        rest = s.held.strip()
        return Writing(), ([(s.key, s.n + 1, rest)] if rest else [])
    held, n, out = s.held + row.text, s.n, []
    while (end := sentence_end(held)) is not None:
        if held[:end].strip():
            n += 1
            out.append((row.key, n, held[:end].strip()))
        held = held[end:]
    return Writing(held, n, row.key), out


# Fixed values of a room: floors in dBFS taken for quiet and loud, what a loud one raises the probability and the least speech to, decibels above the floor at
# which a turn opens and goes on, the speaker's level before it is known with the room left for that, how far under it is far away, and the slack while a turn runs.
QUIET_FLOOR, LOUD_FLOOR, NOISY_ON, NOISY_SHORTEST = -60.0, -35.0, 0.8, 400.0
START_SNR, END_SNR, ASSUMED_LEVEL, ASSUMED_MARGIN, FAR_DB, SLACK_DB = 9.0, 4.0, -26.0, 2.0, 8.0, 6.0
RISE, FALL = 0.5, 0.15


@dataclass(frozen=True)
class Gated:
    """ST-03: a room's floor and its speaker's level, and the utterance that is heard or held back."""

    noise: Noise = Noise()
    user: float | None = None
    started: int | None = None
    speech: int = 0
    silence: int = 0
    paused: bool = False
    announced: bool = False
    levels: tuple[float, ...] = ()


def gated(on: float = ON):
    """ST-03: endpointing in a noisy room. An utterance opens at a probability that rises with the noise floor, by a frame well above it, but is held back:
    it is announced once it holds the least speech (which rises too), is in no silence, and its level, the 80th percentile of its speech frames, isn't far
    below the speaker's. While it runs, frames at the floor or far below the speaker's level are silence whatever their probability. One that
    ends unannounced or too short is dropped; one that ends announced moves the speaker's level, quickly up and slowly down.

    Rows: key, frame_no, event (announce, resume, pause, close, discard), speech_ms, silence_ms, level.
    """

    def least_level(s: Gated) -> float:
        return s.user - FAR_DB if s.user is not None else ASSUMED_LEVEL - FAR_DB - ASSUMED_MARGIN

    def step(s: Gated | None, row):
        s = s or Gated()
        if row is None:
            return s, []
        out, heard = [], noise(s.noise, row)[0]
        s = replace(s, noise=replace(heard, speech=()))
        share = min(1.0, max(0.0, (heard.floor - QUIET_FLOOR) / (LOUD_FLOOR - QUIET_FLOOR)))
        opens, shortest = on + (max(NOISY_ON, on) - on) * share, SHORTEST + (max(NOISY_SHORTEST, SHORTEST) - SHORTEST) * share
        off = max(on - OFF_BELOW, OFF_LEAST)

        def emit(event: str, s: Gated) -> None:
            out.append((row.key, row.frame_no, event, s.speech, s.silence, round(_percentile(list(s.levels), LEVEL_AT), 4) if s.levels else None))

        def announced(s: Gated) -> Gated:
            if s.announced or s.speech < shortest or s.silence or (s.levels and _percentile(list(s.levels), LEVEL_AT) < least_level(s)):
                return s
            s = replace(s, announced=True)
            emit("announce", s)
            return s

        if s.started is None:
            if row.p >= opens and row.level >= heard.floor + START_SNR:
                s = announced(replace(s, started=max(0, row.frame_no - PRE_ROLL // FRAME_MS), speech=FRAME_MS, silence=0, paused=False, announced=False, levels=(row.level,)))
            return s, out
        audible = row.level >= heard.floor + END_SNR and row.level >= least_level(s) - SLACK_DB
        if row.p >= on and audible:
            if s.silence and s.paused:
                emit("resume", s)
            s = replace(s, speech=s.speech + s.silence + FRAME_MS, silence=0, paused=False, levels=(*s.levels, row.level))
        elif row.p < off or s.silence or not audible:
            s = replace(s, silence=s.silence + FRAME_MS)
        else:
            s = replace(s, speech=s.speech + FRAME_MS)
        s = announced(s)
        if s.silence >= CLOSE_SILENCE or s.speech + s.silence >= LONGEST:
            whole = s.announced and s.speech >= shortest
            emit("close" if whole else "discard", s)
            level = _percentile(list(s.levels), LEVEL_AT) if whole and s.levels else None
            user = s.user if level is None else level if s.user is None else s.user + (level - s.user) * (RISE if level > s.user else FALL)
            s = Gated(s.noise, user)
        elif s.announced and not s.paused and s.silence >= HALF_SILENCE and s.speech >= shortest:
            s = replace(s, paused=True)
            emit("pause", s)
        return s, out

    return step
