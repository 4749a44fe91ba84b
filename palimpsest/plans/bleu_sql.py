"""SQL for BLEU of pairs of tokenised texts."""

from __future__ import annotations


def grams_sql(texts: str, name: str) -> dict[str, str]:
    """N-gram counts ``<name>(id, n, g, c)`` of ``texts(id, t)``."""
    return {
        f"{name}_w": f"""SELECT id, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4
          FROM (SELECT id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM {texts})
          WINDOW p AS (PARTITION BY id ORDER BY i)""",
        name: f"""SELECT id, n, g, count(*) AS c FROM (
          SELECT id, 1 AS n, w AS g FROM {name}_w
          UNION ALL SELECT id, 2, w || chr(1) || w2 FROM {name}_w WHERE w2 IS NOT NULL
          UNION ALL SELECT id, 3, w || chr(1) || w2 || chr(1) || w3 FROM {name}_w WHERE w3 IS NOT NULL
          UNION ALL SELECT id, 4, w || chr(1) || w2 || chr(1) || w3 || chr(1) || w4 FROM {name}_w WHERE w4 IS NOT NULL)
          GROUP BY 1, 2, 3""",
    }


def bleu_sql(texts: str, pairs: str, name: str = "bleu") -> dict[str, str]:
    """Derivations ending in ``name(k, bleu)`` for ``pairs(k, r, h)``, ids of
    ``texts(id, t)``; ``<name>_n`` holds ``k, n, hit, total, rl, hl``."""
    return {
        **grams_sql(texts, f"{name}_g"),
        f"{name}_s": f"""SELECT k, a.n, sum(least(a.c, b.c)) AS hit FROM {pairs} p JOIN {name}_g a ON a.id = p.r
          JOIN {name}_g b ON b.id = p.h AND b.n = a.n AND b.g = a.g GROUP BY 1, 2""",
        f"{name}_l": f"""SELECT p.k, len(a.t) AS rl, len(b.t) AS hl FROM {pairs} p JOIN {texts} a ON a.id = p.r JOIN {texts} b ON b.id = p.h""",
        f"{name}_n": f"""SELECT l.k, o.n, coalesce(s.hit, 0) AS hit, greatest(hl - o.n + 1, 1) AS total, rl, hl
          FROM {name}_l l CROSS JOIN (VALUES (1), (2), (3), (4)) AS o(n) LEFT JOIN {name}_s s ON s.k = l.k AND s.n = o.n""",
        f"{name}_p": f"""SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS z FROM {name}_n""",
        name: f"""SELECT k, CASE WHEN max(hl) = 0 OR max(CASE WHEN n = 1 THEN hit END) = 0 THEN 0.0 ELSE
          CASE WHEN max(hl) > max(rl) THEN 1.0 ELSE exp(1.0 - max(rl)::DOUBLE / max(hl)) END *
          exp(sum(ln(CASE WHEN hit = 0 THEN 1.0 / (pow(2.0, z) * total) ELSE hit::DOUBLE / total END) / 4)) END AS bleu
          FROM {name}_p GROUP BY k""",
    }


# the tokenised sides of every edit pair and the pairs of their ids
def pair_texts(tokens_sql) -> dict[str, str]:
    return {
        "toks": f"""SELECT pair_id * 2 AS id, {tokens_sql('tgt')} AS t FROM edit_pairs
          UNION ALL SELECT pair_id * 2 + 1, {tokens_sql('src')} FROM edit_pairs""",
        "pairs": "SELECT pair_id AS k, pair_id * 2 AS r, pair_id * 2 + 1 AS h FROM edit_pairs",
    }
