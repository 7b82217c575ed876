"""SQL fragments that the oracles share."""


def normal(x: str) -> str:
    return rf"regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({normal(x)}, '\s+'), lambda x: x <> '')"


TOK = f"tok AS MATERIALIZED (SELECT doc_id AS block_id, lang AS namespace, source, text, {tokens('text')} AS tokens FROM documents)"
POST = "post AS MATERIALIZED (SELECT term, block_id, count(*) AS tf, min(pos) AS pos FROM (SELECT block_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tok) GROUP BY term, block_id)"
LEX = "lex AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term)"
STATS = "st AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS a FROM tok)"
INDEX = f"{TOK}, {POST}, {LEX}, {STATS}"


def part(tf: str = "tf") -> str:
    return f"ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * ({tf} * 2.5::DOUBLE) / ({tf} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(tokens) / a)))"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::BIGINT" if isinstance(v, int) else str(v) for v in r) + ")" for r in rows)


def fnv(x: str) -> str:
    """FNV-1a of 32 bits over UTF-16 code units."""
    units = f"flatten(list_transform(string_split({x}, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN [55296 + (unicode(x)::BIGINT - 65536) // 1024, 56320 + (unicode(x)::BIGINT - 65536) % 1024] ELSE [unicode(x)::BIGINT] END))"
    return f"lpad(to_hex(list_reduce(list_prepend(2166136261::BIGINT, {units}), lambda h, c: xor(h, c) * 16777619 % 4294967296)).lower(), 8, '0')"


def label(x: str) -> str:
    """A claim label."""
    return rf"substr(trim(regexp_replace({normal(x)}, '\s+', ' ', 'g')), 1, 200)"
