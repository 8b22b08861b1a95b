"""Problem 4: one consistent form for text that looks the same.

The work runs in DuckDB inside the Arrow partitions: embedded SQL composes
accents (nfc_normalize), maps compatibility forms and look-alike letters
(translate) and removes invisible characters (regular expressions).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, letter case kept.
CYRILLIC = ("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХІЈЅҮ", "aeopcyxijshdqwlABEKMHOPCTXIJSY")
GREEK = ("οινΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "oivABEZHIKMNOPTYXcj")
RADICALS = ("⺠⻄⻅⻆⻉⻋⻓⻔⻘⻚⻛⻜⻝⻢⻤⻥⻦⻩⻬⻮⻰", "民西见角贝车长门青页风飞食马鬼鱼鸟黄齐齿龙")
OTHER = ("ɑɡıℓ‐‑’ʼ‘ˈ", "agil--''''")
#: Invisible characters: joiners, marks of direction, soft hyphen, byte order mark, selectors.
INVISIBLE = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E007F}\\x{E0100}-\\x{E01EF}]"
#: White space other than a line break that shows as a space.
SPACES = "[\\t\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
#: Blocks whose compatibility forms look like the characters they stand for.
BLOCKS = [(0x2E80, 0x2FDF), (0xFF01, 0xFFEF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F), (0x1D400, 0x1D7FF), (0x2100, 0x214F), (0x2160, 0x217F)]
#: Half-width sound marks combine with the letter before them.
SOUND_MARKS = ("ﾞﾟ", "゙゚")
#: Bytes of aliases that one pass over the texts takes to the workers.
BLOCK_BYTES = 4_000_000


@cache
def tables() -> tuple[str, str, list[tuple[str, str]]]:
    """(characters, their single-character forms, forms of several characters), by the Unicode rule.

    A digit never stands for a letter or the other way round: forms that change
    between the two are left out.
    """
    source, target, several = [], [], []
    for first, last in BLOCKS:
        for code in range(first, last + 1):
            c = chr(code)
            form = unicodedata.normalize("NFKC", c)
            if form == c or c in SOUND_MARKS[0] or unicodedata.category(c) == "Cn":
                continue
            if len(form) == 1:
                source.append(c)
                target.append(form)
    for code in (*range(0xFB00, 0xFB07), 0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x2026):
        several.append((chr(code), unicodedata.normalize("NFKC", chr(code))))
    for pair in (CYRILLIC, GREEK, RADICALS, OTHER, SOUND_MARKS):
        source += pair[0]
        target += pair[1]
    return "".join(source), "".join(target), several


@cache
def composing() -> str:
    """The characters that composition may change, as ranges of a regular expression, by the Unicode rule.

    These are the marks that are reordered, the second halves of composed
    characters, the letters that hangul syllables are made of, and those that
    have another canonical form.
    """
    codes = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        if unicodedata.combining(c):
            codes.add(code)
            continue
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            pair = parts.split()
            if len(pair) == 2:
                codes.add(int(pair[1], 16))
            if unicodedata.normalize("NFC", c) != c:
                codes.add(code)
    out, ordered = [], sorted(codes)
    for code in ordered:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def _connect() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    source, target, several = tables()
    connection.execute("CREATE TABLE forms (source VARCHAR, target VARCHAR)")
    connection.execute("INSERT INTO forms VALUES (?, ?)", [source, target])
    # the characters of a text that need work at all are found by one regular expression
    odd = "[" + INVISIBLE[1:-1] + SPACES[1:-1] + "".join(f"\\x{{{ord(c):X}}}" for c in dict.fromkeys(source + "".join(f for f, _ in several))) + composing() + "]"
    replaced = "x"
    for form, letters in several:
        replaced = f"replace({replaced}, '{form}', '{letters}')"
    connection.execute(
        f"CREATE MACRO consistent(x) AS CASE WHEN regexp_matches(x, '{odd}') THEN nfc_normalize(regexp_replace(regexp_replace("
        f"translate({replaced}, (SELECT source FROM forms), (SELECT target FROM forms)), '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g')) ELSE x END"
    )
    return connection


def _forms_sql() -> tuple[str, str]:
    """(a common table expression of the forms, SQL of the consistent form of ``_column_``)."""
    source, target, several = (x.replace("'", "''") if isinstance(x, str) else x for x in tables())
    inner = "_column_"
    for form, letters in several:
        inner = f"replace({inner}, '{form}', '{letters}')"
    form = f"nfc_normalize(regexp_replace(regexp_replace(translate({inner}, source, target), '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g'))"
    return f"forms AS (SELECT '{source}' AS source, '{target}' AS target)", form


def texts_sql() -> str:
    forms, form = _forms_sql()
    return f"WITH {forms} SELECT chunk_key, {form.replace('_column_', 'text')} AS text FROM chunks, forms"


def found_sql() -> str:
    """``readable_aliases`` over the whole tables as one query, without Spark: what its result is compared with."""
    forms, form = _forms_sql()
    return f"""
        WITH {forms}, texts AS (SELECT chunk_key, profile, text AS raw, {form.replace('_column_', 'text')} AS form FROM chunks, forms WHERE text <> ''),
        given AS (SELECT rule_key, profile, unnest(aliases) AS raw FROM rules WHERE profile IS NOT NULL),
        aliases_ AS (SELECT rule_key, profile, raw, {form.replace('_column_', 'raw')} AS form FROM given, forms WHERE raw <> '')
        SELECT rule_key, chunk_key FROM texts JOIN aliases_ USING (profile) WHERE aliases_.form <> '' GROUP BY rule_key, chunk_key
        HAVING bool_or(contains(texts.form, aliases_.form)) AND NOT bool_or(contains(texts.raw, aliases_.raw))"""


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text) with the text in its consistent form.

    Null stays null, an empty text empty; repeated rows stay repeated; other
    columns are not read; an empty table gives an empty table.
    """
    picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = _connect()
        for batch in batches:
            connection.register("batch", pa.table({"key": batch.column(0), "raw": batch.column(1)}))
            out = connection.execute("SELECT key, consistent(raw) AS text FROM batch").to_arrow_table()
            yield from out.rename_columns([key, "text"]).to_batches()

    return picked.mapInArrow(run, f"`{key}` {picked.schema['key'].dataType.simpleString()}, text string")


def _flat(rules: list) -> pa.Table:
    flat = [(r["rule_key"], r["profile"], a) for r in rules for a in r["aliases"] or () if a]
    return pa.table({"rule_key": pa.array([f[0] for f in flat], pa.int64()), "profile": pa.array([f[1] for f in flat], pa.string()), "raw": pa.array([f[2] for f in flat], pa.string())})


def _find_in_block(chunks: DataFrame, rules: list) -> DataFrame:
    aliases = _flat(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = _connect()
        connection.register("given", aliases)
        connection.execute("CREATE TABLE aliases AS SELECT rule_key, profile, raw, consistent(raw) AS form FROM given WHERE consistent(raw) <> ''")
        for batch in batches:
            connection.register("batch", pa.Table.from_batches([batch]))
            found = connection.execute(
                """
                WITH texts AS (SELECT chunk_key, profile, text AS raw, consistent(text) AS form, row_number() OVER () AS n FROM batch WHERE text <> '')
                SELECT rule_key, any_value(chunk_key) AS chunk_key
                FROM texts JOIN aliases USING (profile)
                GROUP BY rule_key, n
                HAVING bool_or(contains(texts.form, aliases.form)) AND NOT bool_or(contains(texts.raw, aliases.raw))
                """
            ).to_arrow_table()
            yield from found.to_batches()

    return chunks.select("chunk_key", "profile", "text").mapInArrow(run, "rule_key bigint, chunk_key bigint")


def readable_aliases(chunks: DataFrame, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (rule_key, chunk_key) of one profile where an alias can be read in the text but none stands there as given.

    Rules go to the workers in blocks of at most about ``block_bytes`` of
    aliases, each block against all texts. Null or empty texts, aliases and alias
    lists match nothing, nor does an alias of invisible characters only; a null
    profile or key of a rule matches none. Repeated rows give one pair.
    """
    aliases = rules.where(F.col("profile").isNotNull() & F.col("rule_key").isNotNull() & (F.size(F.coalesce("aliases", F.array())) > 0)).select("rule_key", "profile", "aliases")
    total = aliases.select(F.sum(F.octet_length(F.array_join("aliases", "")) + 16 * F.size("aliases"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = None
    for block in range(blocks):
        share = aliases if blocks == 1 else aliases.where(F.pmod(F.xxhash64("rule_key"), F.lit(blocks)) == block)
        found = _find_in_block(chunks, share.collect())
        out = found if out is None else out.unionByName(found)
    return out.distinct()
