"""Chord and key labels as pitch-class masks, and the tonal distance between them.

A label is turned into three 12-bit masks (root, root and fifth, all chord tones) and a key into
a fourth (its diatonic set). The distance of a chord y from a chord x is ``i + j + k``
(Lerdahl 1988): fifths between the keys, steps between the roots on the diatonic circle of
fifths, and the pitch classes that are new in y, counted once per level.

Labels are parsed once per distinct label; events join the masks and compute distances with
integer expressions, so the hot path stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SILENCE_DISTANCE = 13

# Pitch classes of the note letters.
LETTER_PC = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}

# Semitones above the root of each chord shorthand.
SHORTHAND = {
    "maj": (0, 4, 7), "min": (0, 3, 7), "dim": (0, 3, 6), "aug": (0, 4, 8),
    "maj7": (0, 4, 7, 11), "min7": (0, 3, 7, 10), "7": (0, 4, 7, 10), "dim7": (0, 3, 6, 9),
    "hdim7": (0, 3, 6, 10), "minmaj7": (0, 3, 7, 11), "aug7": (0, 4, 8, 10),
    "maj6": (0, 4, 7, 9), "min6": (0, 3, 7, 9), "6": (0, 4, 7, 9),
    "9": (0, 2, 4, 7, 10), "maj9": (0, 2, 4, 7, 11), "min9": (0, 2, 3, 7, 10),
    "11": (0, 2, 4, 5, 7, 10), "min11": (0, 2, 3, 5, 7, 10), "maj11": (0, 2, 4, 5, 7, 11),
    "13": (0, 2, 4, 5, 7, 9, 10), "min13": (0, 2, 3, 5, 7, 9, 10),
    "maj13": (0, 2, 4, 5, 7, 9, 11),
    "sus2": (0, 2, 7), "sus4": (0, 5, 7), "5": (0, 7), "1": (0,),
}

# Semitones of the scale degrees 1..7 of the major scale.
DEGREE_SEMITONES = (0, 2, 4, 5, 7, 9, 11)

# Steps on the diatonic circle of fifths between two roots, by interval in
# semitones.
ROOT_STEPS = (0, 2, 2, 3, 3, 1, 1, 1, 3, 3, 2, 2)

MAJOR_MASK = sum(1 << s for s in DEGREE_SEMITONES)


def _mask(semitones) -> int:
    return sum(1 << s for s in semitones)


def _map(table: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in table.items()) + ")"


def _array(values) -> str:
    return "array(" + ", ".join(str(v) for v in values) + ")"


def _let(value: str, var: str, body: str) -> str:
    """SQL text that evaluates ``value`` once under the name ``var``."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shift(accidentals: str) -> str:
    """Semitones of a string of sharps and flats."""
    return f"(2 * length(replace({accidentals}, 'b', '')) - length({accidentals}))"


def _note_pc(label: str) -> str:
    """Pitch class of the note a label starts with; null if it does not start with one."""
    letter = f"try_element_at({_map(LETTER_PC)}, regexp_extract({label}, '^([A-G])[b#]*', 1))"
    return f"pmod({letter} + {_shift(f"regexp_extract({label}, '^[A-G]([b#]*)', 1)")}, 12)"


def _silent(label: str) -> str:
    """No chord (or key): null, empty, ``N`` or ``X``."""
    return f"coalesce({label} IN ('', 'N', 'X'), true)"


def _rotate(mask: str | int, steps: str) -> str:
    """Transpose a 12-bit mask upwards."""
    return f"((shiftleft({mask}, {steps}) | shiftright({mask}, 12 - {steps})) & 4095)"


def _degree_mask(degrees: str, removed: bool) -> str:
    """Union of the degrees of a list that are (or are not) marked as left out by ``*``."""
    number = "try_cast(regexp_extract(_d, '([0-9]+)', 1) AS int)"
    shift = _shift("regexp_extract(_d, '([b#]*)[0-9]', 1)")
    semitone = f"pmod(get({_array(DEGREE_SEMITONES)}, ({number} - 1) % 7) + {shift}, 12)"
    chosen = f"filter({degrees}, _d -> _d <> '' AND startswith(_d, '*') = {str(removed).lower()})"
    return f"aggregate({chosen}, 0, (_acc, _d) -> _acc | coalesce(shiftleft(1, {semitone}), 0))"


def _mask_struct(root: str, rel: str) -> str:
    """Masks of the chord with the tones ``rel`` above ``root``."""
    # the fifth of a chord is its perfect, diminished or augmented one, in this order
    fifth = "CASE " + " ".join(f"WHEN {rel} & {1 << s} <> 0 THEN {1 | 1 << s}" for s in (7, 6, 8)) + " ELSE 1 END"
    return (f"named_struct('root', {root}, 'root_mask', {_rotate(1, root)}, "
            f"'fifth_mask', {_rotate(f'({fifth})', root)}, 'chord_mask', {_rotate(rel, root)})")


def chord_masks(label: str) -> Column:
    """``struct<root, root_mask, fifth_mask, chord_mask>`` of a label column; null for no chord.

    Grammar: ``root[b#]* (:shorthand)? ((degrees))? (/bass)?``. A bass note does not change
    the masks. An unknown shorthand counts as a major triad. Meant for the distinct labels of
    a corpus (``vocabulary``), which are then joined to the events.
    """
    tail = f"regexp_extract({label}, '^[A-G][b#]*:([^/]*)', 1)"
    degrees = rf"split(replace(regexp_extract(_t, r'\(([^)]*)\)', 1), ' ', ''), ',')"
    parsed = f"named_struct('tail', _t, 'name', regexp_extract(_t, '^([A-Za-z0-9]*)', 1), 'degrees', {degrees})"
    named = _map({k: _mask(v) for k, v in SHORTHAND.items()})
    base = (f"CASE WHEN _p.name = '' AND _p.tail <> '' THEN 1 "
            f"ELSE coalesce(try_element_at({named}, _p.name), {_mask(SHORTHAND['maj'])}) END")
    rel = f"((({base}) | {_degree_mask('_p.degrees', False)}) & ~{_degree_mask('_p.degrees', True)})"
    tones = _let(tail, "_t", _let(parsed, "_p", rel))
    body = _let(f"named_struct('root', {_note_pc(label)}, 'rel', {tones})", "_c", _mask_struct("_c.root", "_c.rel"))
    return F.expr(f"CASE WHEN NOT {_silent(label)} AND {label} RLIKE '^[A-G]' THEN {body} END")


def key_info(key: str) -> Column:
    """``struct<label, tonic, minor, scale, scale_mask>`` of ``C``, ``Dm``, ``C:major`` ....

    ``scale`` is the tonic of the major scale with the same notes: minor keys use their
    relative major. Null for no key.
    """
    rest = f"lower(regexp_extract({key}, '^[A-G][b#]*:?(.*)$', 1))"
    minor = f"({rest} = 'm' OR startswith({rest}, 'min') OR startswith({rest}, 'aeolian'))"
    scale = "pmod(_k.tonic + CASE WHEN _k.minor THEN 3 ELSE 0 END, 12)"
    body = _let(f"named_struct('tonic', {_note_pc(key)}, 'minor', {minor})", "_k",
                f"named_struct('label', {key}, 'tonic', _k.tonic, 'minor', _k.minor, 'scale', {scale}, "
                f"'scale_mask', {_rotate(MAJOR_MASK, scale)})")
    return F.expr(f"CASE WHEN NOT {_silent(key)} AND {key} RLIKE '^[A-G]' THEN {body} END")


def tonic_chord(key: str) -> Column:
    """The tonic triad of a ``key_info`` column as a chord label; no key gives no chord."""
    return F.expr(f"CASE WHEN {key} IS NULL THEN 'N' ELSE concat(regexp_extract({key}.label, '^([A-G][b#]*)', 1), "
                  f"CASE WHEN {key}.minor THEN ':min' ELSE ':maj' END) END")


def tonic_masks(key: str) -> Column:
    """The masks of ``tonic_chord`` without parsing a label."""
    rel = f"CASE WHEN {key}.minor THEN {_mask(SHORTHAND['min'])} ELSE {_mask(SHORTHAND['maj'])} END"
    return F.expr(f"CASE WHEN {key} IS NOT NULL THEN {_mask_struct(f'{key}.tonic', f'({rel})')} END")


def tps_distance(y: str, ky: str, x: str, kx: str) -> Column:
    """Distance of chord ``y`` in key ``ky`` from ``x`` in ``kx``: mask and key columns.

    Two silent chords are at 0, a silent and a sounding one at 13. If exactly one key is
    missing, the distance is 13; if both are, the key terms are 0.
    """
    new = " + ".join(f"bit_count({y}.{m} & ~{x}.{m})" for m in ("root_mask", "fifth_mask", "chord_mask"))
    steps = f"get({_array(ROOT_STEPS)}, pmod({y}.root - {x}.root, 12))"
    fifths = f"pmod(({ky}.scale - {kx}.scale) * 7, 12)"
    keys = f"least({fifths}, 12 - {fifths}) + bit_count({ky}.scale_mask & ~{kx}.scale_mask)"
    return F.expr(f"""cast(CASE
        WHEN {y} IS NULL AND {x} IS NULL THEN 0
        WHEN {y} IS NULL OR {x} IS NULL OR ({ky} IS NULL) <> ({kx} IS NULL) THEN {SILENCE_DISTANCE}
        ELSE {steps} + {new} + CASE WHEN {ky} IS NULL THEN 0 ELSE {keys} END END AS int)""")


def vocabulary(labels: DataFrame, label: str, parse, name: str) -> DataFrame:
    """The distinct values of a label column, each parsed once."""
    return labels.select(label).filter(F.col(label).isNotNull()).distinct().withColumn(name, parse(label))


def chord_pitches(masks: str, octave_base: int = 60) -> Column:
    """MIDI pitches of a chord-mask column, ascending from the root in the octave of ``octave_base``."""
    return F.expr(f"""CASE WHEN {masks} IS NOT NULL THEN transform(
        filter(sequence(0, 11), _s -> shiftright({masks}.chord_mask, pmod({masks}.root + _s, 12)) & 1 = 1),
        _s -> {octave_base} + {masks}.root + _s) END""")
