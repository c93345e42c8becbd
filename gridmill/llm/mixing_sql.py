"""The mix of ``mixing.mix_sources`` with its default parameters, as DuckDB SQL."""


def mix_sql(documents: str = "documents", share: float = 1.5, repeats: int = 2, block: int = 16, shard_docs: int = 20_000, seed: str = "mix") -> str:
    return f"""
WITH own AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM {documents}),
sizes AS (SELECT key, sum(size)::BIGINT AS source_size, count(*) AS docs FROM own GROUP BY key),
listed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(key)) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         source_size * {float(repeats)}::DOUBLE AS cap, sum(source_size) OVER () * {share}::DOUBLE AS mix FROM sizes),
levels AS (
  SELECT *, (mix - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(key) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, encode(key) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM listed),
targets AS (
  SELECT key, source_size, docs, floor(mix / {block})::BIGINT AS blocks,
         CASE WHEN cap / weight <= level THEN cap ELSE weight * (SELECT level FROM levels WHERE cap / weight > level ORDER BY cap / weight, encode(key) LIMIT 1) END AS target
  FROM levels),
seats AS (
  SELECT key, target, blocks, unnest(range(1, blocks + 1)) AS seat FROM targets WHERE target > 0),
won AS (
  SELECT key FROM seats QUALIFY row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, encode(key), seat) <= blocks),
quotas AS (
  SELECT t.key, source_size, target, ceil(docs / {float(shard_docs)})::BIGINT AS shards, coalesce(n, 0)::BIGINT AS quota
  FROM targets t LEFT JOIN (SELECT key, count(*) AS n FROM won GROUP BY key) USING (key)),
placed AS (
  SELECT o.*, ('0x' || substr(h, 1, 12))::BIGINT % shards AS shard FROM own o JOIN quotas USING (key)),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY key, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop,
         sum(size) OVER (PARTITION BY key, shard) AS words FROM placed),
shards AS (
  SELECT key, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota FROM placed JOIN quotas USING (key) GROUP BY key, shard),
shard_seats AS (
  SELECT key, shard, words, quota, unnest(range(1, quota + 1)) AS seat FROM shards WHERE words > 0),
shard_won AS (
  SELECT key, shard FROM shard_seats
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY words / (2 * seat - 1) DESC, shard, seat) <= quota),
takes AS (
  SELECT s.key, s.shard, least(coalesce(n, 0) * {block}, s.words * {repeats})::BIGINT AS take,
         CASE WHEN s.words > 0 THEN (('0x' || substr(md5('{seed}' || s.key || '/' || s.shard::VARCHAR), 1, 12))::BIGINT
              % ceil(s.words / {float(block)})::BIGINT) * {block} ELSE 0 END AS start
  FROM shards s LEFT JOIN (SELECT key, shard, count(*) AS n FROM shard_won GROUP BY key, shard) USING (key, shard)),
parts AS (
  SELECT doc_id, size, source_size, target, stop - size AS a, stop AS b, greatest(o.words, 1) AS words, start, take,
         take // greatest(o.words, 1) AS rounds, take - (take // greatest(o.words, 1)) * greatest(o.words, 1) AS rest
  FROM ordered o JOIN takes USING (key, shard) JOIN quotas USING (key))
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(b, start + rest, words) - greatest(a, start))
        + greatest(0, least(b, start + rest - words) - a))::BIGINT AS taken,
       (CASE WHEN a < start AND greatest(0, least(b, start + rest, words) - greatest(a, start)) > 0 THEN start - a ELSE 0 END)::BIGINT AS first_word
FROM parts
"""
