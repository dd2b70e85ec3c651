"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PLAIN = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: Every window of 35 words by its whole text, counted over the corpus.
SUBSTRING = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35),
windows AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS w FROM starts),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS pos FROM windows JOIN twice USING (w)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (r, pos) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)"""

#: Windows that share a five-word shingle with an item, measured exactly.
DECONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS ws FROM documents),
own AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
items AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS size FROM own WHERE len(ws) > 0),
places AS (SELECT item_id, ws, n, size, unnest(range(1, n - size + 2)) AS place FROM items),
item_shingles AS (SELECT item_id, n, size, place, array_to_string(ws[place:place + size - 1], ' ') AS s FROM places),
sizes AS (SELECT DISTINCT size FROM items),
spots AS (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM docs, sizes WHERE len(ws) >= size),
doc_shingles AS (SELECT r, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS s FROM spots),
seeds AS (SELECT DISTINCT r, item_id, n, size, greatest(pos - place, 0) AS start FROM doc_shingles JOIN item_shingles USING (s, size)),
bag AS (SELECT seeds.r, seeds.item_id, start, d.s, count(*) AS c FROM seeds JOIN doc_shingles d
        ON d.r = seeds.r AND d.size = seeds.size AND d.pos BETWEEN start + 1 AND start + n - seeds.size + 1 GROUP BY ALL),
item_bag AS (SELECT item_id, s, count(*) AS c FROM item_shingles GROUP BY ALL),
shared AS (SELECT r, bag.item_id, start, sum(least(bag.c, i.c)) AS m FROM bag JOIN item_bag i ON i.item_id = bag.item_id AND i.s = bag.s GROUP BY ALL),
totals AS (SELECT r, item_id, start, sum(c) AS k FROM bag GROUP BY ALL),
item_totals AS (SELECT item_id, any_value(n) AS n, count(*) AS k FROM item_shingles GROUP BY item_id),
scored AS (SELECT r, item_id, start, n, CAST(m AS DOUBLE) / CAST(t.k + i.k - m AS DOUBLE) AS similarity
           FROM shared JOIN totals t USING (r, item_id, start) JOIN item_totals i USING (item_id)),
best AS (SELECT doc_id, item_id, similarity, start, n, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place
         FROM scored JOIN docs USING (r) WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words FROM best WHERE place = 1"""
