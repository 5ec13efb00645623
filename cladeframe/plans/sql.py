"""DuckDB SQL for the orthology queries that SQL can express."""

_ORDER = """op AS (SELECT l_orderkey AS query, l_partkey AS leaf, bool_and(l_returnflag <> 'R') AS ortho FROM lineitem GROUP BY ALL)"""
_COUNTS = (
    _ORDER
    + """, pc AS (
  SELECT x.leaf AS a, y.leaf AS b, sum((x.ortho AND y.ortho)::INT)::BIGINT AS n_ortho, sum((x.ortho <> y.ortho)::INT)::BIGINT AS n_para
  FROM op x JOIN op y ON x.query = y.query AND x.leaf::VARCHAR < y.leaf::VARCHAR WHERE x.ortho OR y.ortho GROUP BY ALL HAVING sum((x.ortho AND y.ortho)::INT) >= 2)"""
)
_EDGES = (
    _COUNTS
    + """, ne AS (SELECT a AS src, b AS dst, n_ortho AS n FROM pc WHERE n_ortho > n_para UNION ALL SELECT b, a, n_ortho FROM pc WHERE n_ortho > n_para),
mx AS (SELECT src, max(n) AS most FROM ne GROUP BY src),
ew AS (SELECT ne.src, ne.dst, ne.n, ne.n::DOUBLE / m.most AS weight, ne.n::DOUBLE / k.most AS back FROM ne JOIN mx m ON m.src = ne.src JOIN mx k ON k.src = ne.dst),
se AS (SELECT src, dst, weight FROM ew WHERE weight >= 0.7::DOUBLE AND back >= 0.7::DOUBLE)"""
)
_SPANS = """sg AS (SELECT x.l_partkey AS query, y.target, x.l_linenumber AS qstart, x.l_linenumber + x.l_quantity::INT AS qend
  FROM lineitem x JOIN (SELECT DISTINCT l_orderkey, l_partkey AS target FROM lineitem) y USING (l_orderkey)),
sp AS (SELECT query, target, min(qstart) AS qstart, max(qend) AS qend FROM sg WHERE query <> target GROUP BY ALL)"""
_HIT_EDGES = _EDGES + ", " + _SPANS + """, he AS (SELECT se.*, qstart, qend FROM se LEFT JOIN sp ON src = query AND dst = target),
oh AS (SELECT query, target FROM sp WHERE NOT EXISTS (SELECT 1 FROM se WHERE src = query AND dst = target))"""
_CO = """lp AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
co AS (SELECT x.l_partkey AS query, y.l_partkey AS target, count(*) AS n FROM lp x JOIN lp y USING (l_orderkey) WHERE x.l_partkey <> y.l_partkey GROUP BY ALL)"""
_BEST = _CO + """, rk AS (SELECT query, target, p_brand AS species, n, row_number() OVER (PARTITION BY query, p_brand ORDER BY n DESC, target)::INT AS rank
  FROM co JOIN part ON p_partkey = target), best AS (SELECT * FROM rk WHERE rank <= 6)"""
_MEMBERS = """mb AS (SELECT query, target AS member FROM hits UNION SELECT query, query FROM hits),
cs AS (SELECT query, sum(n)::BIGINT AS n_members, count(*) AS n_present, count(*) FILTER (n > 1) AS n_dupli
  FROM (SELECT query, p_brand, count(*) AS n FROM mb JOIN part ON p_partkey = member GROUP BY ALL) GROUP BY query)"""
_LADDER = """fe AS (SELECT user_id, event_id % 97 AS leaf, min({'ts': ts, 'e': event_id}) AS t0 FROM events GROUP BY ALL),
rn AS (SELECT *, row_number() OVER w AS rn, first(leaf) OVER w AS query FROM fe WINDOW w AS (PARTITION BY user_id ORDER BY t0)),
ld AS (SELECT query, leaf, min(rn // 2)::INT AS step, leaf % 23 AS species FROM rn GROUP BY query, leaf)"""
_STEPS = """seen AS (SELECT DISTINCT {g}query, species, step FROM {ld}),
fs AS (SELECT *, min(step) OVER (PARTITION BY {g}query, species) AS fst FROM seen),
ps AS (SELECT {g}query, step, count(*) AS sister, count(*) FILTER (fst < step) AS overlap FROM fs GROUP BY {g}query, step),
st AS (SELECT *, coalesce(sum(sister - overlap) OVER (PARTITION BY {g}query ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS browsed FROM ps)"""
_GOOD = _LADDER + ", " + _STEPS.format(g="", ld="ld") + """, lg AS (
  SELECT query, coalesce(max(step) FILTER (browsed + sister - overlap = 1 OR (overlap / sister <= 0.5::DOUBLE AND overlap / browsed <= 0.5::DOUBLE)), 0) AS last_good
  FROM st WHERE step > 0 GROUP BY query)"""
_PRUNED = _LADDER + """, og AS (SELECT 'OG_' || (i % 3) AS og_name, i AS protein_id FROM range(97) t(i)),
gl AS (SELECT l.query, l.leaf, l.step, l.species, q.og_name FROM ld l JOIN og q ON q.protein_id = l.query JOIN og m ON m.protein_id = l.leaf AND m.og_name = q.og_name), """ + _STEPS.format(
    g="og_name, ", ld="gl"
) + """, ev AS (SELECT og_name, query, step, browsed + sister - overlap = 1 OR overlap = 0 OR (overlap = 1 AND sister - overlap >= 2 AND browsed - overlap >= 2) AS o FROM st WHERE step > 0),
pe AS (SELECT og_name, x.leaf AS a, y.leaf AS b, sum(o::INT)::BIGINT AS n_ortho, sum((NOT o)::INT)::BIGINT AS n_para
  FROM gl x JOIN gl y USING (og_name, query) JOIN ev USING (og_name, query) WHERE y.leaf::VARCHAR < x.leaf::VARCHAR AND x.step <> y.step AND ev.step = greatest(x.step, y.step) GROUP BY og_name, x.leaf, y.leaf)"""
_SEG = """sc AS (SELECT * FROM (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY')) t(species_id, file_name)),
pr AS (SELECT c_custkey AS protein_id, species_id, c_name AS name FROM customer JOIN sc ON c_mktsegment = file_name),
cl AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal::DOUBLE / 500)) AS rep FROM customer),
gr AS (SELECT c_custkey AS id, c_nationkey AS og FROM customer WHERE c_custkey IN (SELECT rep FROM cl)),
gn AS (SELECT og, row_number() OVER (ORDER BY min(id), count(*), og) AS number FROM gr JOIN pr ON id = protein_id GROUP BY og HAVING count(DISTINCT species_id) > 1),
og AS (SELECT 'OG_' || number AS og_name, id AS protein_id FROM gr JOIN gn USING (og)),
fu AS (SELECT og_name, og.protein_id AS rep_id, p.protein_id, species_id, name FROM og JOIN cl ON rep = og.protein_id JOIN pr p ON p.protein_id = cl.id)"""

_PROPAGATION = _EDGES.replace("0.7", "0.1") + """, dg AS (SELECT src, count(*) AS degree FROM se GROUP BY src),
nr AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM se),
ok AS (SELECT nr.src, nr.dst FROM nr JOIN dg USING (src) WHERE k <= 50 AND degree >= 4),
cl AS (SELECT x.src, count(*) AS found FROM ok x JOIN ok y ON x.src = y.src AND x.dst < y.dst JOIN se e ON e.src = x.dst AND e.dst = y.dst GROUP BY x.src),
lc AS (SELECT dg.src AS id, CASE WHEN degree >= 4 THEN round_even(2.0::DOUBLE * coalesce(found, 0) / CASE WHEN degree > 50 THEN 2450 ELSE degree * (degree - 1) END, 5) ELSE 0 END AS lcc FROM dg LEFT JOIN cl USING (src)),
reach AS (SELECT src AS node, src AS r FROM dg UNION SELECT se.dst, r FROM reach JOIN se ON se.src = node WHERE r < se.dst),
mb AS (SELECT node AS id, min(r) AS component FROM reach GROUP BY node),
kd AS (SELECT component, count(*) < 4 OR count(DISTINCT p_brand) = 1 AS plain FROM mb JOIN part ON p_partkey = id GROUP BY component),
nd AS (SELECT id, row_number() OVER (ORDER BY lcc DESC, id) AS i FROM lc JOIN mb USING (id) JOIN kd USING (component) WHERE NOT plain),
nb AS (SELECT x.i, list({'w': round_even(weight * 1099511627776, 0)::BIGINT, 'd': -dst, 'i': y.i}) AS near FROM se JOIN nd x ON x.id = src JOIN nd y ON y.id = dst GROUP BY x.i),
lp AS (
  SELECT 0::BIGINT AS step, list(id ORDER BY i) AS state, 0::BIGINT AS quiet FROM nd
  UNION ALL
  SELECT step + 1, list_concat(state[1:i - 1], [best], state[i + 1:]), CASE WHEN best = state[i] THEN quiet + 1 ELSE 0 END
  FROM (SELECT lp.*, i, list_max(list_transform(near, lambda x: {'s': list_sum(list_transform(list_filter(near, lambda y: state[y.i] = state[x.i]), lambda y: y.w)), 'w': x.w, 'd': x.d, 'l': state[x.i]})).l AS best
        FROM lp JOIN nb ON nb.i = step % len(state) + 1 WHERE quiet < len(state))),
og AS (SELECT id, component, component AS og FROM mb JOIN kd USING (component) WHERE plain
  UNION ALL SELECT id, component, (SELECT arg_max(state, step) FROM lp)[i] FROM nd JOIN mb USING (id))
SELECT id, component, og, count(DISTINCT og) OVER (PARTITION BY component) > 1 AS split FROM og"""

_PART_KMERS = """km AS (SELECT DISTINCT id, grp, k FROM (SELECT p_partkey AS id, p_brand AS grp, substr(p_name, i, 12) AS k FROM (
  SELECT *, unnest(range(1, length(p_name) - 10)) AS i FROM part WHERE length(p_name) >= 12))
  WHERE len(list_distinct(string_split(k, ''))) >= 6 AND NOT contains(k, 'X') AND NOT contains(k, '*'))"""
_PART_CLUSTERS = (
    _PART_KMERS
    + """, st AS (SELECT DISTINCT min(id) OVER (PARTITION BY grp, k) AS u, id AS v FROM km), e AS (SELECT u, v FROM st WHERE u <> v UNION SELECT v, u FROM st WHERE u <> v),
reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.v, r FROM reach JOIN e ON e.u = node WHERE r < e.v),
cm AS (SELECT p_partkey AS id, p_brand AS grp, length(p_name) AS size, coalesce(c, p_partkey) AS c FROM part LEFT JOIN (SELECT node, min(r) AS c FROM reach GROUP BY node) ON node = p_partkey),
cl AS (SELECT first_value(id) OVER (PARTITION BY c ORDER BY size DESC, id) AS rep_id, id AS member_id, grp FROM cm)"""
)

SQL = {
    "fasta_parse": r"""
SELECT doc_id, 'd' || doc_id || ' ' || lang AS header, 'd' || doc_id AS name, regexp_replace(text, '\s*\n|\s+$', '', 'g') AS seq FROM documents""",
    "duplicate_names": """
SELECT p_name AS protein_name, file1, p_brand AS file2 FROM (
  SELECT *, row_number() OVER w AS rn, first(p_brand) OVER w AS file1 FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)) WHERE rn > 1""",
    "hit_file": f"""WITH {_BEST} SELECT query, target, 1 AS qstart, (9 + target % 20)::INT AS qend, 1 AS sstart, (9 + target % 20) || 'M' AS cigar, 1 AS ord FROM best""",
    "tree_file": """SELECT o_custkey AS query, '(' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ');' AS newick FROM orders GROUP BY o_custkey""",
    "stage_table": f"WITH {_COUNTS} SELECT * FROM pc",
    "proteome_files": "SELECT p_partkey::VARCHAR AS name, p_name AS seq FROM part",
    "kmer_valid": f"WITH {_PART_KMERS} SELECT p_partkey AS id, coalesce(n, 0) AS n_valid FROM part LEFT JOIN (SELECT id, count(*) AS n FROM km GROUP BY id) ON id = p_partkey",
    "kmer_shared_parts": f"""WITH {_PART_KMERS}, c AS (SELECT grp, k, count(*) AS n FROM km GROUP BY grp, k)
SELECT grp, count(*) FILTER (n > 1) AS n_shared, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_postings FROM c GROUP BY grp""",
    "kmer_cluster_parts": f"WITH RECURSIVE {_PART_CLUSTERS} SELECT rep_id, member_id, grp FROM cl",
    "cluster_log_parts": f"""WITH RECURSIVE {_PART_CLUSTERS} SELECT grp AS "index", grp AS file_name, count(*) AS nb_initial, count(DISTINCT rep_id) AS nb_final FROM cl GROUP BY grp""",
    "topk_per_group": f"WITH {_BEST} SELECT * FROM best",
    "hit_census": f"WITH {_BEST}, hits AS (SELECT * FROM best), {_MEMBERS} SELECT *, n_present > 1 AND n_dupli > 0 AS has_tree FROM cs",
    "route_no_tree": f"WITH {_BEST}, hits AS (SELECT * FROM best WHERE n > 1), {_MEMBERS} SELECT query, member FROM mb JOIN cs USING (query) WHERE NOT (n_present > 1 AND n_dupli > 0)",
    "cigar_expand": """
SELECT doc_id, array_to_string(list_transform(range(length(text) // 50), lambda i: substr(text, 50 * i + 1, 40) || '--'), '') || substr(text, 50 * (length(text) // 50) + 1) AS hsp FROM documents""",
    "gap_columns": """
WITH a AS (SELECT p_brand AS query, translate(rpad(p_name, 16, '-'), ' e', '--') AS r FROM part),
c AS (SELECT query, unnest(range(16))::INT AS position, r FROM a)
SELECT query, position, count(*) FILTER (substr(r, position + 1, 1) = '-') AS gaps, count(*) AS "rows", count(*) FILTER (substr(r, position + 1, 1) = '-') / count(*) < 0.7::DOUBLE AS good
FROM c GROUP BY query, position""",
    "alignment_rows": f"""WITH {_BEST}, sq AS (SELECT p_partkey AS id, rpad(p_name, 64, '.') AS seq FROM part),
ht AS (SELECT query, target, 1 + target % 9 AS c1, 1 + query % 5 AS t1, 15 + query % 31 AS c2, 1 + target % 40 AS t2 FROM best),
ce AS (SELECT query, target, c, CASE
    WHEN c BETWEEN c2 AND c2 + 17 THEN CASE WHEN c - c2 < 5 THEN substr(seq, t2 + c - c2, 1) WHEN c - c2 < 7 THEN '-' ELSE substr(seq, t2 + c - c2 - 2, 1) END
    WHEN c BETWEEN c1 AND c1 + 21 THEN CASE WHEN c - c1 < 12 THEN substr(seq, t1 + c - c1, 1) WHEN c - c1 < 15 THEN '-' ELSE substr(seq, t1 + c - c1 + 1, 1) END
    ELSE '-' END AS x FROM ht JOIN sq ON id = target, (SELECT unnest(range(1, 65)) AS c)
  UNION ALL SELECT id, id, c, substr(seq, c, 1) FROM sq, (SELECT unnest(range(1, 65)) AS c) WHERE id IN (SELECT query FROM best)),
gd AS (SELECT query, c FROM ce GROUP BY query, c HAVING count(*) FILTER (x = '-') / count(*) < 0.7::DOUBLE)
SELECT query, target, string_agg(x, '' ORDER BY c) AS "row" FROM ce JOIN gd USING (query, c) GROUP BY query, target""",
    "hit_hull": f"WITH {_SPANS} SELECT * FROM sp",
    "edge_hits": f"WITH {_HIT_EDGES} SELECT * FROM he",
    "other_hits": f"WITH {_HIT_EDGES} SELECT * FROM oh",
    "ladder_steps": f"WITH {_LADDER}, {_STEPS.format(g='', ld='ld')} SELECT query, step, sister, overlap, browsed FROM st WHERE step > 0",
    "ladder_last_good": f"WITH {_GOOD} SELECT * FROM lg",
    "ladder_pairs": f"""WITH {_GOOD}, lb AS (SELECT ld.query, leaf, step <= coalesce(last_good, 0) AS o FROM ld LEFT JOIN lg USING (query))
SELECT x.leaf AS a, y.leaf AS b, sum((x.o AND y.o)::INT)::BIGINT AS n_ortho, sum((x.o <> y.o)::INT)::BIGINT AS n_para
FROM lb x JOIN lb y ON x.query = y.query AND x.leaf::VARCHAR < y.leaf::VARCHAR WHERE x.o OR y.o GROUP BY ALL HAVING sum((x.o AND y.o)::INT) >= 2""",
    "pair_count": f"WITH {_COUNTS} SELECT * FROM pc",
    "pair_count_groups": f"""WITH {_ORDER}
SELECT x.leaf AS a, y.leaf AS b, count(*) AS n_ortho, 0::BIGINT AS n_para FROM op x JOIN op y ON x.query = y.query AND x.leaf::VARCHAR < y.leaf::VARCHAR GROUP BY ALL HAVING count(*) >= 2""",
    "pruned_events": f"WITH {_PRUNED} SELECT * FROM pe",
    "ortholog_pairs": f"WITH {_PRUNED} SELECT * FROM pe WHERE n_ortho::DOUBLE / (n_ortho + n_para) > 0.5::DOUBLE",
    "pair_expand": f"""WITH {_COUNTS}, c AS (SELECT p_partkey - p_partkey % 2 AS rep, p_brand, p_name || '-' || p_partkey AS name FROM part)
SELECT x.name AS name1, y.name AS name2 FROM pc JOIN part s ON s.p_partkey = a JOIN part t ON t.p_partkey = b JOIN c x ON x.rep = a JOIN c y ON y.rep = b
WHERE n_ortho > n_para AND s.p_brand <> t.p_brand""",
    "edge_weights": f"WITH {_EDGES} SELECT * FROM ew",
    "strong_edges": f"WITH {_EDGES} SELECT * FROM se",
    "weight_histogram": f"""WITH {_EDGES}, h AS (SELECT round_even(20 * weight, 0)::INT AS bin, count(*) AS n FROM ew GROUP BY ALL)
SELECT i / 20.0::DOUBLE AS edge_weight, coalesce(n, 0) AS nb_edges FROM range(21) t(i) LEFT JOIN h ON bin = i""",
    "network_size": f"WITH {_EDGES} SELECT count(DISTINCT src) AS nodes, count(*) FILTER (src < dst) AS edges FROM ne",
    "lcc": f"""WITH {_CO}, e AS (SELECT query AS src, target AS dst FROM co),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e), dg AS (SELECT src, count(*) AS degree FROM e GROUP BY src),
nr AS (SELECT r.src, r.dst FROM r JOIN dg USING (src) WHERE k <= 50 AND degree >= 4),
f AS (SELECT x.src, count(*) AS found FROM nr x JOIN nr y ON x.src = y.src AND x.dst < y.dst JOIN e ON e.src = x.dst AND e.dst = y.dst GROUP BY x.src)
SELECT dg.src AS id, degree, CASE WHEN degree >= 4 THEN round_even(2.0::DOUBLE * coalesce(found, 0) / CASE WHEN degree > 50 THEN 2450 ELSE degree * (degree - 1) END, 5) ELSE 0 END AS lcc
FROM dg LEFT JOIN f USING (src)""",
    "label_propagation": f"WITH RECURSIVE {_PROPAGATION}",
    "label_propagation_steps": f"WITH RECURSIVE {_PROPAGATION}",
    "components": f"""WITH RECURSIVE {_COUNTS}, e AS (SELECT a AS u, b AS v FROM pc UNION SELECT b, a FROM pc),
reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.v, r FROM reach JOIN e ON e.u = node WHERE r < e.v)
SELECT node, min(r) AS component FROM reach GROUP BY node""",
    "chimeras": f"""WITH {_SPANS}, l AS (
  SELECT src, a.p_size AS own, b.p_size AS og, count(DISTINCT b.p_brand) AS s, count(*) AS n, quantile_cont(qstart, 0.5) AS q1, quantile_cont(qend, 0.5) AS q2
  FROM (SELECT query AS src, target AS dst, qstart, qend FROM sp) JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst GROUP BY ALL),
ok AS (SELECT l.* FROM l JOIN (SELECT p_size, count(*) AS size FROM part GROUP BY ALL) z ON z.p_size = og WHERE s >= 2 AND n >= size * 0.05::DOUBLE),
rf AS (SELECT src, q1 AS r1, q2 AS r2 FROM ok WHERE own = og)
SELECT src AS id, og::BIGINT AS og FROM ok JOIN rf USING (src) WHERE own <> og AND CASE WHEN q1 > r1 THEN r2 - q1 ELSE q2 - r1 END <= 0""",
    "supported": f"""WITH {_HIT_EDGES}, m AS (SELECT p_partkey AS id, p_size::BIGINT AS og FROM part),
h AS (SELECT src AS id, dst AS k FROM he WHERE qend IS NOT NULL UNION SELECT query, target FROM oh),
i AS (SELECT h.id, x.og, count(*) AS n FROM h JOIN m x ON x.id = h.id JOIN m y ON y.id = k AND y.og = x.og GROUP BY ALL)
SELECT m.id, m.og FROM m JOIN (SELECT og, count(*) AS size FROM m GROUP BY og) z USING (og) LEFT JOIN i ON i.id = m.id AND i.og = m.og WHERE size <= 3 OR coalesce(n, 0) >= 2""",
    "og_names": f"WITH {_SEG} SELECT * FROM og",
    "og_lists": f"WITH {_SEG} SELECT og_name, string_agg(name, ' ' ORDER BY name) AS protein_names FROM fu GROUP BY og_name",
    "og_statistics": f"""WITH {_SEG}, b AS (SELECT og_name, count(DISTINCT species_id) AS nb_species, count(*) AS nb_reduced_prot FROM og JOIN pr USING (protein_id) GROUP BY og_name),
e AS (SELECT og_name, count(*) AS nb_all_prot FROM fu GROUP BY og_name),
i AS (SELECT x.og_name, count(*) AS n FROM customer JOIN og x ON x.protein_id = c_custkey JOIN og y ON y.protein_id = c_custkey + 50 AND y.og_name = x.og_name GROUP BY x.og_name)
SELECT og_name, nb_species, nb_reduced_prot, nb_all_prot, coalesce(round_even(coalesce(n, 0)::DOUBLE / nullif(nb_reduced_prot * (nb_reduced_prot - 1), 0), 4), 0) AS clustering_coefficient
FROM b JOIN e USING (og_name) LEFT JOIN i USING (og_name)""",
    "og_counts": f"""WITH {_SEG} SELECT og_name, {", ".join(f"count(*) FILTER (species_id = {i}) AS {n}" for i, n in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))} FROM fu GROUP BY og_name""",
    "og_member_names": f"""WITH {_SEG} SELECT og_name, {", ".join(f"coalesce(string_agg(name, ' ' ORDER BY name) FILTER (species_id = {i}), '') AS {n}" for i, n in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))} FROM fu GROUP BY og_name""",
    "og_unclassified": f"WITH {_SEG} SELECT DISTINCT name AS protein_name FROM pr WHERE name NOT IN (SELECT name FROM fu WHERE og_name <> 'OG_1')",
    "og_species_statistics": f"""WITH {_SEG}, t AS (SELECT species_id, count(*) AS total FROM pr GROUP BY ALL), g AS (SELECT species_id, count(*) AS n FROM fu GROUP BY ALL)
SELECT file_name AS species, round_even(100.0::DOUBLE * coalesce(n, 0) / total, 1) AS perc_prot_assigned, coalesce(n, 0) AS nb_prot_assigned FROM sc JOIN t USING (species_id) LEFT JOIN g USING (species_id)""",
    "og_species_histogram": f"""WITH {_SEG}, b AS (SELECT og_name, count(DISTINCT species_id) AS k FROM og JOIN pr USING (protein_id) GROUP BY og_name), h AS (SELECT k, count(*) AS n FROM b GROUP BY k)
SELECT i AS nb_species, coalesce(n, 0) AS nb_OGs FROM range(6) t(i) LEFT JOIN h ON k = i""",
    "chimera_report": f"""WITH {_SEG}, l AS (SELECT protein_id, count(*)::INT AS n, string_agg(og_name, ' ' ORDER BY og_name) AS ogs FROM og GROUP BY protein_id)
SELECT file_name AS species_file, name AS protein_name, coalesce(n, 0)::INT AS nb_OG_fused, coalesce(ogs, '') AS list_fused_OGs
FROM pr JOIN sc USING (species_id) LEFT JOIN l USING (protein_id)""",
}
