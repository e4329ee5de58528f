"""SQL of the queries that SQL can express where it takes more than a statement: built from steps, for DuckDB."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text: the reflected polynomial, bit by bit."""
    octets = f"[('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen({text}))]"
    bits = "[0::BIGINT FOR i IN range(8)]"
    steps = f"lambda crc, octet: list_reduce(list_prepend(xor(crc, octet), {bits}), lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {steps}), 4294967295)"


def merkle(levels: int = 9, group_levels: int = 5) -> str:
    """Trees of up to ``8 ** levels`` leaves and ``8 ** group_levels`` groups."""

    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    lowered = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    steps = [
        f"docs AS (SELECT *, {crc32('doc_id::VARCHAR')} AS crc FROM documents)",
        f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(f'({lowered})')} AS seen FROM docs)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves)",
        "n0 AS (SELECT lang AS tree, slot, leaf AS h FROM placed)",
    ]

    def climb(name: str, count: int) -> None:
        for level in range(count):
            run = "PARTITION BY tree, slot // 8 ORDER BY slot ROWS BETWEEN"
            steps.append(
                f"{name}s{level} AS (SELECT tree, slot, h, count(*) OVER (PARTITION BY tree) AS nodes,"
                f" coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{level})"
            )
            up = "CASE WHEN any_value(nodes) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY slot)) END"
            steps.append(f"{name}{level + 1} AS (SELECT tree, slot // 8 AS slot, {up} AS h FROM {name}s{level} GROUP BY tree, slot // 8)")

    climb("n", levels)
    steps.append(f"m0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS slot, h, tree AS lang FROM n{levels})")
    climb("m", group_levels)
    steps.append(
        f"f0 AS (SELECT p.*, m0.slot AS nth, m0.h AS subroot, (SELECT h FROM m{group_levels}) AS root, seen AS fold, '' AS proof"
        " FROM placed p JOIN m0 ON p.lang IS NOT DISTINCT FROM m0.lang)"
    )
    number = 0
    for name, count, tree, place in (("n", levels, "f.lang", "f.slot"), ("m", group_levels, "0", "f.nth")):
        for level in range(count):
            steps.append(
                f"f{number + 1} AS (SELECT f.* REPLACE (CASE WHEN s.nodes = 1 THEN f.fold ELSE sha256(s.l || f.fold || s.r) END AS fold,"
                f" CASE WHEN s.nodes = 1 THEN f.proof ELSE f.proof || s.l || s.r END AS proof)"
                f" FROM f{number} f JOIN {name}s{level} s ON s.tree IS NOT DISTINCT FROM {tree} AND s.slot = {place} // {8**level})"
            )
            number += 1
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256,"
        f" fold AS folded_root, fold = root AS verified FROM f{number}"
    )


def variants() -> str:
    """Words, their near words by the forms that lack one letter, and forms followed to the last."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS prefix,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS (
  SELECT prefix, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32("(prefix || run)")} AS h FROM counted
), spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, slot, substr(word, 1, slot) || substr(word, slot + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS slot FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.slot = b.slot AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION
  SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest
), best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS nth FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND nth = 1
), followed AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT f.word, forms.form FROM followed f JOIN forms ON forms.word = f.root WHERE forms.form IS NOT NULL
), ends AS (
  SELECT f.word, f.root FROM followed f JOIN forms ON forms.word = f.root WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
