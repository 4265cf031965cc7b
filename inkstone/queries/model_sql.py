"""SQL of the sequence models: segmentation, tags, entities, keywords, translation and phrase trees, as common table expressions.

Every function gives the text of CTEs for a WITH RECURSIVE clause. The models' tables (counts of word and tag sequences) are
counted here anew from the lists of the lexicon.
"""

from __future__ import annotations

import math
from collections import defaultdict

from ..functions.text import SPACE_CLASS
from ..models.entities import PATTERNS
from ..models.lexicon import DEFAULT
from ..models.kernels import LEAST_SIMILARITY, PLACE_WEIGHT, WINDOW
from ..models.segment import CHARACTER_ADD_K, UNKNOWN_WEIGHT
from ..models.tagger import TAG_ADD_K
from ..models.translate import PUNCTUATION
from ..operators.graph import DAMPING, ROUNDS, TOLERANCE

_HAN = r"[\x{4e00}-\x{9fff}]"
_RUNS = rf"{_HAN}+|[a-zA-Z0-9]+(?:[.\-@][a-zA-Z0-9]+)*|[^{SPACE_CLASS}\x{{4e00}}-\x{{9fff}}]"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(words) -> str:
    return "[" + ", ".join(map(text, words)) + "]"


def number(x: float) -> str:
    """A double's literal; without an exponent it would be a decimal."""
    r = repr(float(x))
    return r if "e" in r else r + "e0"


def numbers(xs) -> str:
    return "[" + ", ".join(map(number, xs)) + "]"


def rows(table: str, columns: str, values) -> str:
    shown = ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else number(x) if isinstance(x, float) else repr(x) for x in row) + ")" for row in values)
    return f"{table}({columns}) AS (VALUES {shown})"


def _chain(sequences, states, add_k: float):
    """Log probabilities (start, transitions, emissions) of (observation, state) sequences, as plain dictionaries."""
    start, trans, emit = defaultdict(lambda: add_k), defaultdict(lambda: add_k), defaultdict(lambda: add_k)
    for s in sequences:
        start[s[0][1]] += 1
        for (_, a), (_, b) in zip(s, s[1:]):
            trans[a, b] += 1
        for o, a in s:
            emit[o, a] += 1

    def logs(counts):
        whole = math.fsum(counts)
        return [math.log(c / whole) for c in counts]

    return logs([start[a] for a in states]), [logs([trans[a, b] for b in states]) for a in states], {o: logs([emit[o, a] for a in states]) for o in sorted({o for o, _ in emit})}


def segmented(source: str) -> str:
    """CTEs that end in words(id, n, i, word): the words of the texts of `source`, a query of (id, text), in order of (n, i)."""
    dictionary = DEFAULT.dictionary
    total, longest = sum(dictionary.values()), max(map(len, dictionary))
    states = "BMES"
    start, trans, emit = _chain([list(zip(w, "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E")) for w in dictionary], states, CHARACTER_ADD_K)
    lengths = range(1, longest + 1)
    hits = ", ".join(f"d{k}.p" for k in lengths)
    joins = " ".join(f"LEFT JOIN lexicon d{k} ON d{k}.word = substring(run, i, {k}) AND i + {k - 1} <= length(run)" for k in lengths)
    through = ", ".join(f"hits[i - 1][{k}] + best[{k}]" for k in lengths)
    moves = "[" + ", ".join("[" + ", ".join(f"score[{a + 1}] + {number(trans[a][b])}" for a in range(4)) + "]" for b in range(4)) + "]"
    return f"""
    source AS ({source}),
    {rows("lexicon", "word, p", ((w, math.log(f / total)) for w, f in dictionary.items()))},
    emission(ch, e) AS (VALUES {", ".join(f"({text(c)}, {numbers(e)})" for c, e in emit.items())}),
    pieces AS (SELECT id, generate_subscripts(t, 1) AS n, unnest(t) AS piece FROM (SELECT id, regexp_extract_all(text, {text(_RUNS)}) AS t FROM source)),
    runs AS MATERIALIZED (SELECT DISTINCT piece AS run FROM pieces WHERE regexp_matches(piece, '^{_HAN}')),
    places AS (SELECT run, unnest(generate_series(1, length(run))) AS i FROM runs),
    looked_up AS (SELECT run, list(h ORDER BY i) AS hits FROM (SELECT run, i, [{hits}] AS h FROM places {joins}) GROUP BY run),
    way AS (
        SELECT run, hits, length(run) + 1 AS i, [0.0::DOUBLE] AS best, NULL::BIGINT AS size FROM looked_up
        UNION ALL
        SELECT run, hits, i - 1, list_prepend(coalesce(list_max(s), {number(math.log(UNKNOWN_WEIGHT / total))} + best[1]), best[1:{longest - 1}]), coalesce(list_position(s, list_max(s)), 1)
        FROM (SELECT *, [{through}] AS s FROM way WHERE i > 1)
    ),
    sizes AS MATERIALIZED (SELECT run, list(size ORDER BY i) AS size FROM way WHERE size IS NOT NULL GROUP BY run),
    walk AS (SELECT run, size, 1::BIGINT AS i FROM sizes UNION ALL SELECT run, size, i + size[i] FROM walk WHERE i + size[i] <= length(run)),
    found AS (SELECT run, i, substring(run, i, size[i]) AS word, size[i] = 1 AND substring(run, i, 1) NOT IN (SELECT word FROM lexicon) AS unknown FROM walk),
    islands AS (SELECT *, sum(CASE WHEN unknown THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY i) AS island FROM found),
    unknown_runs AS MATERIALIZED (SELECT run, min(i) AS i, string_agg(word, '' ORDER BY i) AS s FROM islands WHERE unknown GROUP BY run, island),
    strings AS (SELECT s, list(coalesce(e, {numbers([math.log(CHARACTER_ADD_K)] * 4)}) ORDER BY p) AS es FROM (
        SELECT s, p, e FROM (SELECT s, unnest(generate_series(1, length(s))) AS p FROM (SELECT DISTINCT s FROM unknown_runs)) LEFT JOIN emission ON ch = substring(s, p, 1)) GROUP BY s),
    tagging AS (
        SELECT s, es, 1::BIGINT AS p, [{", ".join(f"{number(x)} + es[1][{a + 1}]" for a, x in enumerate(start))}] AS score, NULL::BIGINT[] AS back FROM strings
        UNION ALL
        SELECT s, es, p + 1, list_transform([1, 2, 3, 4], lambda b: list_max(m[b]) + es[p + 1][b]), list_transform([1, 2, 3, 4], lambda b: list_position(m[b], list_max(m[b])))
        FROM (SELECT *, {moves} AS m FROM tagging WHERE p < length(s))
    ),
    backs AS (SELECT s, list(back ORDER BY p) AS backs, arg_max(list_position(score, list_max(score)), p) AS last FROM tagging GROUP BY s),
    tagged_back AS (SELECT s, backs, length(s) AS p, last AS state FROM backs UNION ALL SELECT s, backs, p - 1, backs[p][state] FROM tagged_back WHERE p > 1),
    joined AS (SELECT s, p, sum(CASE WHEN p = 1 OR state IN (1, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY p) AS w FROM tagged_back),
    made AS (SELECT s, min(p) AS p, string_agg(substring(s, p, 1), '' ORDER BY p) AS word FROM joined GROUP BY s, w),
    segments AS (SELECT run, i, word FROM found WHERE NOT unknown UNION ALL SELECT run, i + p - 1, word FROM unknown_runs JOIN made USING (s)),
    words AS MATERIALIZED (SELECT id, n, coalesce(i, 1) AS i, coalesce(word, piece) AS word FROM pieces LEFT JOIN segments ON run = piece)"""


def tagged(words: str = "words", pos: str = "row_number() OVER (PARTITION BY id ORDER BY n, i)") -> str:
    """CTEs that end in tagged(id, p, word, tag), places from 1, of a table (id, ..., word) of words in the order of `pos`."""
    lex, tags = DEFAULT, list(DEFAULT.tags)
    start, trans, emit = _chain([*lex.tagged, *([(w, t)] for w, t in lex.parts_of_speech.items())], tags, TAG_ADD_K)
    known = "MAP {" + ", ".join(f"{text(w)}: {text(t)}" for w, t in lex.parts_of_speech.items()) + "}"
    ends = lambda suffixes: " OR ".join(f"ends_with(word, {text(s)})" for s in suffixes)
    suffixes = " ".join(f"WHEN ends_with(word, {text(s)}) THEN {texts(t)}" for s, t in lex.suffix_tags.items())
    return f"""
    seen_words(word, e) AS (VALUES {", ".join(f"({text(w)}, {numbers(e)})" for w, e in emit.items())}),
    places_of AS MATERIALIZED (SELECT id, {pos} AS p, word FROM {words}),
    candidates AS (
        SELECT word, CASE
            WHEN known[word] IS NOT NULL THEN [known[word]]
            WHEN NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}]') THEN ['x']
            WHEN word IN {tuple(sorted(lex.locations))} THEN ['ns'] WHEN word IN {tuple(sorted(lex.organizations))} THEN ['nt'] WHEN word IN {tuple(sorted(lex.persons))} THEN ['nr']
            WHEN regexp_full_match(word, '[0-9]+([.][0-9]+)?%?') THEN ['m'] WHEN regexp_full_match(word, '[0-9]+[年月日]') THEN ['t'] WHEN regexp_matches(word, '[0-9]') THEN ['m', 'n']
            WHEN {ends(lex.location_suffixes)} THEN ['ns', 'n'] WHEN {ends(lex.organization_suffixes)} THEN ['nt', 'n']
            WHEN length(word) <= 3 AND contains({text("".join(sorted(lex.surnames)))}, word[1]) THEN ['nr', 'n']
            {suffixes} ELSE ['n', 'v', 'a'] END AS options
        FROM (SELECT DISTINCT word, {known} AS known FROM places_of)
    ),
    states AS (SELECT word, list_sort(list_transform(options, lambda t: list_position({texts(tags)}, t))) AS c, e FROM candidates LEFT JOIN seen_words USING (word)),
    options AS (SELECT word, c, list_transform(c, lambda x: coalesce(e[x], {number(math.log(TAG_ADD_K))})) AS e FROM states),
    sequences AS (SELECT id, list(c ORDER BY p) AS cs, list(e ORDER BY p) AS es, count(*) AS n FROM places_of JOIN options USING (word) GROUP BY id),
    decoding AS (
        SELECT id, cs, es, n, 1::BIGINT AS p, list_transform(generate_series(1, len(cs[1])), lambda j: {numbers(start)}[cs[1][j]] + es[1][j]) AS score, NULL::BIGINT[] AS back FROM sequences
        UNION ALL
        SELECT id, cs, es, n, p + 1, list_transform(generate_series(1, len(m)), lambda j: list_max(m[j]) + es[p + 1][j]), list_transform(m, lambda x: list_position(x, list_max(x)))
        FROM (SELECT *, list_transform(cs[p + 1], lambda b: list_transform(generate_series(1, len(cs[p])), lambda j: score[j] + [{", ".join(map(numbers, trans))}][cs[p][j]][b])) AS m FROM decoding WHERE p < n)
    ),
    paths AS (SELECT id, any_value(cs) AS cs, list(back ORDER BY p) AS backs, arg_max(list_position(score, list_max(score)), p) AS last, any_value(n) AS n FROM decoding GROUP BY id),
    traced AS (SELECT id, cs, backs, n AS p, last AS j FROM paths UNION ALL SELECT id, cs, backs, p - 1, backs[p][j] FROM traced WHERE p > 1),
    tagged AS MATERIALIZED (SELECT id, p, word, {texts(tags)}[cs[p][j]] AS tag FROM traced JOIN places_of USING (id, p))"""


def translated() -> str:
    """CTEs that end in translated(id, translation), of words(id, n, i, word) and source(id, text)."""
    table = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in DEFAULT.zh_en.items()) + "}"
    pick = " ".join(f"WHEN len(w) >= pos + {k - 1} AND {table}[array_to_string(w[pos:pos + {k - 1}], '')] IS NOT NULL THEN {k}" for k in (4, 3, 2, 1))
    return f"""
    listed AS (SELECT id, list(word ORDER BY n, i) AS w FROM words GROUP BY id),
    reading AS (
        SELECT id, w, 1::BIGINT AS pos FROM listed
        UNION ALL
        SELECT id, w, pos + greatest(k, 1) FROM (SELECT id, w, pos, CASE {pick} ELSE 0 END AS k FROM reading WHERE pos <= len(w))
    ),
    steps AS (SELECT id, pos, w, CASE {pick} ELSE 0 END AS k FROM reading WHERE pos <= len(w)),
    shown AS (SELECT id, pos, CASE WHEN k > 0 THEN {table}[array_to_string(w[pos:pos + k - 1], '')] ELSE w[pos] END AS x FROM steps WHERE k > 0 OR NOT contains({text(PUNCTUATION)}, w[pos])),
    sentence AS (SELECT id, trim(string_agg(x, ' ' ORDER BY pos)) AS s FROM shown GROUP BY id),
    translated AS (SELECT source.id, coalesce(CASE WHEN s = '' THEN '' ELSE upper(s[1]) || s[2:] || CASE WHEN regexp_matches(s, '[.!?]$') THEN '' ELSE '.' END END, '') AS translation FROM source LEFT JOIN sentence USING (id))"""


def entities() -> str:
    """CTEs that end in entities(id, n, start_pos, end_pos, text, type), of source(id, text), pieces and words."""
    lex = DEFAULT
    found = []
    for kind, names in (("PERSON", lex.persons), ("LOCATION", lex.locations), ("ORGANIZATION", lex.organizations)):
        found += [(w, kind) for w in names]
    kinds = "MAP {" + ", ".join(f"{text(w)}: {text(k)}" for w, k in found) + "}"
    names = "|".join(w for w, _ in sorted(found, key=lambda x: -len(x[0])))
    patterns = [(p.replace(r"\d", r"\p{Nd}"), text(kind)) for kind, p in PATTERNS] + [(names, f"{kinds}[m]")]
    spans = " UNION ALL ".join(
        f"""SELECT id, {order} AS first, s AS start_pos, s + length(m) AS end_pos, {kind} AS type FROM (
            SELECT id, unnest(ms) AS m, unnest(list_transform(generate_series(1, len(ms)), lambda k: coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))) AS s
            FROM (SELECT id, regexp_extract_all(text, {text(p)}) AS ms, string_split_regex(text, {text(p)}) AS ps FROM source WHERE regexp_matches(text, {text(p)})))"""
        for order, (p, kind) in enumerate(patterns)
    )
    any_end = lambda suffixes, longer: " OR ".join(f"(ends_with(word, {text(s)}){f' AND length(word) > {len(s)}' if longer else ''})" for s in suffixes)
    return f"""
    ordered AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, i) AS p, word FROM words),
    sought AS (SELECT id, list(word ORDER BY p) AS ws FROM ordered GROUP BY id),
    seeking AS (
        SELECT id, text, ws, 0::BIGINT AS p, 0::BIGINT AS pos, NULL::BIGINT AS s FROM sought JOIN source USING (id)
        UNION ALL
        SELECT id, text, ws, p + 1, pos + f + length(ws[p + 1]), pos + f FROM (SELECT *, instr(substring(text, pos + 1), ws[p + 1]) - 1 AS f FROM seeking WHERE p < len(ws))
    ),
    by_form AS (
        SELECT id, s, ws[p] AS word, CASE
            WHEN length(word) < 2 OR NOT regexp_full_match(word, '{_HAN}+') THEN NULL
            WHEN {any_end(lex.organization_suffixes, True)} THEN 'ORGANIZATION' WHEN {any_end(lex.location_suffixes, True)} THEN 'LOCATION'
            WHEN length(word) <= 3 AND contains({text("".join(sorted(lex.surnames)))}, word[1]) AND word NOT IN (SELECT word FROM lexicon) AND NOT ({any_end(lex.titles, False)})
                AND (length(word) = 2 OR contains({text("".join(sorted(lex.given_characters)))}, word[2])) THEN 'PERSON' END AS type
        FROM seeking WHERE p > 0
    ),
    offered AS ({spans} UNION ALL SELECT id, {len(patterns)}, s, s + length(word), type FROM by_form WHERE type IS NOT NULL),
    in_turn AS (SELECT id, list({{'s': start_pos::BIGINT, 'e': end_pos::BIGINT, 't': type}} ORDER BY first, start_pos) AS c FROM offered GROUP BY id),
    settling AS (
        SELECT id, c, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT, t VARCHAR)[] AS kept FROM in_turn
        UNION ALL
        SELECT id, c, k + 1, CASE WHEN len(list_filter(kept, lambda x: x.s < c[k + 1].e AND c[k + 1].s < x.e)) = 0 THEN list_append(kept, c[k + 1]) ELSE kept END FROM settling WHERE k < len(c)
    ),
    settled AS (SELECT id, unnest(list_sort(kept)) AS x, generate_subscripts(kept, 1) - 1 AS n FROM settling WHERE k = len(c)),
    entities AS (SELECT id, n::INT AS n, x.s::INT AS start_pos, x.e::INT AS end_pos, substring(text, x.s + 1, x.e - x.s) AS text, x.t AS type FROM settled JOIN source USING (id))"""


def ranked(nodes: str, edges: str, check_every: int = 1) -> str:
    """CTEs that end in ranked(id, node, score): PageRank of many graphs at once, of tables (id, node) and (id, src, dst, weight).

    Each graph stops for itself, at the first multiple of `check_every` rounds after which scores moved less than the tolerance.
    """
    return f"""
    gives AS (SELECT id, src, sum(weight) AS s FROM {edges} GROUP BY id, src),
    shares AS MATERIALIZED (SELECT e.id, e.src, e.dst, e.weight / g.s AS share FROM {edges} e JOIN gives g USING (id, src)),
    members AS MATERIALIZED (SELECT n.id, n.node, count(*) OVER (PARTITION BY n.id) AS size, g.src IS NULL AS sink FROM {nodes} n LEFT JOIN gives g ON g.id = n.id AND g.src = n.node),
    ranking AS (
        SELECT id, node, size, sink, 1.0::DOUBLE / size AS score, 0 AS round, true AS moving FROM members
        UNION ALL
        SELECT id, node, size, sink, new, round + 1, round + 1 < {ROUNDS} AND ((round + 1) % {check_every} <> 0 OR sum(abs(new - score)) OVER (PARTITION BY id) >= {number(TOLERANCE)})
        FROM (
            SELECT r.id, r.node, r.size, r.sink, r.score, r.round, {number(1 - DAMPING)} / r.size + {number(DAMPING)} * sum(CASE WHEN r.sink THEN r.score ELSE 0 END) OVER (PARTITION BY r.id) / r.size + coalesce(got.got, 0) AS new
            FROM ranking r LEFT JOIN (SELECT q.id, s.dst, sum({number(DAMPING)} * q.score * s.share) AS got FROM ranking q JOIN shares s ON s.id = q.id AND s.src = q.node GROUP BY q.id, s.dst) got ON got.id = r.id AND got.dst = r.node
            WHERE r.moving
        )
    ),
    ranked AS (SELECT id, node, arg_max(score, round) AS score FROM ranking GROUP BY id, node)"""


def keywords(method: str) -> str:
    """CTEs that end in keywords(id, word, score, freq), not rounded, of tagged(id, p, word, tag)."""
    lex = DEFAULT
    score = {"textrank": "central", "tfidf": "often"}.get(method, "0.5 * often + 0.5 * central")
    return f"""
    chosen AS MATERIALIZED (
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) AS p, word FROM tagged
        WHERE tag IN {tuple(lex.key_tags)} AND word NOT IN {tuple(lex.key_stop)} AND NOT list_contains({texts(sorted(lex.stop_words))}, word) AND (length(word) > 1 OR regexp_matches(word, '{_HAN}')) AND regexp_matches(word, '[^{SPACE_CLASS}]')
    ),
    counted AS (SELECT id, word AS node, count(*) AS c FROM chosen GROUP BY id, word),
    one_way AS (SELECT a.id, a.word AS src, b.word AS dst, 1.0::DOUBLE / (b.p - a.p) AS weight FROM chosen a JOIN chosen b ON a.id = b.id AND b.p BETWEEN a.p + 1 AND a.p + {WINDOW - 1} WHERE a.word <> b.word),
    near AS (SELECT id, src, dst, sum(weight) AS weight FROM (SELECT * FROM one_way UNION ALL SELECT id, dst, src, weight FROM one_way) GROUP BY id, src, dst),
    {ranked("counted", "near")},
    scaled AS (SELECT id, node, c, c::DOUBLE / max(c) OVER (PARTITION BY id) AS often, score / max(score) OVER (PARTITION BY id) AS central FROM ranked JOIN counted USING (id, node)),
    keywords AS (SELECT id, node AS word, {score} AS score, c::DOUBLE AS freq FROM scaled)"""


def trees() -> str:
    """CTEs that end in trees(id, a, b, label, up_a, up_b): spans of each tree and of their parents, of tagged(id, p, word, tag).

    chart is grown from its left parts; a span's split is the first at which some rule for its preferred label holds.
    """
    lex = DEFAULT
    one = [(lhs, parts[0]) for lhs, parts in lex.grammar if len(parts) == 1]
    two = [(lhs, *parts) for lhs, parts in lex.grammar if len(parts) == 2]
    return f"""
    {rows("leaf_rules", "lhs, tag", one)}, {rows("pair_rules", "lhs, l, r", two)}, {rows("preferences", "lhs, rank", [(x, i) for i, x in enumerate(lex.preference)])},
    leaves AS (SELECT id, p AS a, p + 1 AS b, tag AS sym FROM tagged UNION ALL SELECT id, p, p + 1, lhs FROM tagged JOIN leaf_rules USING (tag)),
    lengths AS (SELECT id, max(p) AS n FROM tagged GROUP BY id),
    chart(id, a, b, sym, made) USING KEY (id, a, b, sym) AS (
        SELECT id, a, b, sym, 1::BIGINT FROM leaves
        UNION
        SELECT id, a, b, sym, made FROM (
            SELECT x.id, x.a, y.b, r.lhs AS sym, x.made + 1 AS made FROM chart x JOIN pair_rules r ON r.l = x.sym JOIN recurring.chart y ON y.id = x.id AND y.a = x.b AND y.sym = r.r
            UNION
            SELECT y.id, x.a, y.b, r.lhs, y.made + 1 FROM chart y JOIN pair_rules r ON r.r = y.sym JOIN recurring.chart x ON x.id = y.id AND x.b = y.a AND x.sym = r.l
        ) WHERE (id, a, b, sym) NOT IN (SELECT (id, a, b, sym) FROM recurring.chart)
    ),
    best AS (SELECT id, a, b, arg_min(sym, coalesce(rank, 99)) AS label FROM chart LEFT JOIN preferences ON lhs = sym WHERE b > a + 1 GROUP BY id, a, b),
    splits AS (SELECT s.id, s.a, s.b, s.label, min(x.b) AS k FROM best s JOIN pair_rules r ON r.lhs = s.label JOIN chart x ON x.id = s.id AND x.a = s.a AND x.sym = r.l AND x.b < s.b JOIN chart y ON y.id = s.id AND y.a = x.b AND y.b = s.b AND y.sym = r.r GROUP BY s.id, s.a, s.b, s.label),
    trees AS (
        SELECT l.id, 1::BIGINT AS a, l.n + 1 AS b, NULL::BIGINT AS up_a, NULL::BIGINT AS up_b FROM lengths l
        UNION ALL
        SELECT id, unnest(CASE WHEN k IS NULL THEN generate_series(a, b - 1) ELSE [a, k] END), unnest(CASE WHEN k IS NULL THEN generate_series(a + 1, b) ELSE [k, b] END), a, b
        FROM (SELECT t.id, t.a, t.b, s.k FROM trees t LEFT JOIN splits s ON s.id = t.id AND s.a = t.a AND s.b = t.b WHERE t.b > t.a + 1)
    ),
    labelled AS (SELECT t.*, CASE WHEN t.b = t.a + 1 THEN g.tag ELSE coalesce(s.label, 'S') END AS label, CASE WHEN t.b = t.a + 1 THEN g.word END AS word FROM trees t LEFT JOIN splits s USING (id, a, b) LEFT JOIN tagged g ON g.id = t.id AND g.p = t.a)"""


def content(words: str) -> str:
    """A list of words without stop words, single characters other than Chinese ones, and blanks."""
    return f"list_filter({words}, lambda w: w IS NOT NULL AND NOT list_contains({texts(sorted(DEFAULT.stop_words))}, w) AND (length(w) >= 2 OR regexp_matches(w, '{_HAN}')) AND regexp_matches(w, '[^{SPACE_CLASS}]'))"


def summaries(source: str, ratio: float = 0.3) -> str:
    """CTEs that end in summaries(id, summary, sentences, top_indices), of a query of (id, text)."""
    gap = f"[{SPACE_CLASS}]+"
    return f"""
    summarised AS ({source}),
    split AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){gap}', '\\1' || chr(10), 'g'), '[。！？!?；;' || chr(10) || ']+'), lambda p: regexp_replace(p, '^{gap}|{gap}$', '', 'g')), lambda p: p <> '') AS s FROM summarised),
    parts AS MATERIALIZED (SELECT row_number() OVER () AS part_id, id, idx, part, n FROM (SELECT id, generate_subscripts(s, 1) - 1 AS idx, unnest(s) AS part, len(s) AS n FROM split)),
    {segmented("SELECT part_id AS id, part AS text FROM parts WHERE n > 1")},
    kept AS (SELECT id AS part_id, {content("list(word)")} AS ws FROM words GROUP BY id),
    posted AS MATERIALIZED (
        SELECT id, idx, term, tf * (ln((n + 1) / (count(*) OVER (PARTITION BY id, term) + 1)) + 1) AS w
        FROM (SELECT id, idx, any_value(n) AS n, term, count(*)::DOUBLE / any_value(len(ws)) AS tf FROM (SELECT id, idx, n, ws, unnest(ws) AS term FROM kept JOIN parts USING (part_id)) GROUP BY id, idx, term)
    ),
    norms AS (SELECT id, idx, sqrt(sum(w * w)) AS norm FROM posted GROUP BY id, idx),
    dots AS (SELECT a.id, a.idx AS src, b.idx AS dst, sum(a.w * b.w) AS dot FROM posted a JOIN posted b ON a.id = b.id AND a.term = b.term AND a.idx <> b.idx GROUP BY a.id, a.idx, b.idx),
    likeness AS (SELECT d.id, d.src, d.dst, dot / (a.norm * b.norm) AS weight FROM dots d JOIN norms a ON a.id = d.id AND a.idx = d.src JOIN norms b ON b.id = d.id AND b.idx = d.dst WHERE dot / (a.norm * b.norm) > {number(LEAST_SIMILARITY)}),
    sentence_nodes AS (SELECT id, idx AS node FROM parts WHERE n > 1),
    {ranked("sentence_nodes", "likeness")},
    placed AS (SELECT p.id, p.idx, p.part, p.n, row_number() OVER (PARTITION BY p.id ORDER BY score + {number(PLACE_WEIGHT)} * exp(-p.idx::DOUBLE / p.n * 2) DESC, p.idx) AS place FROM ranked r JOIN parts p ON p.id = r.id AND p.idx = r.node),
    long AS (SELECT id, string_agg(part || '。', '' ORDER BY idx) AS summary, any_value(n) AS n, list(idx::INT ORDER BY idx) AS top FROM placed WHERE place <= least(n, greatest(1, floor(n * {number(ratio)}))) GROUP BY id),
    summaries AS (SELECT s.id, coalesce(long.summary, s.s[1], '') AS summary, len(s.s)::INT AS sentences, coalesce(long.top, CASE WHEN len(s.s) = 1 THEN [0] ELSE [] END)::INT[] AS top_indices FROM split s LEFT JOIN long USING (id))"""


def powers(table: str, steps: int = 15) -> str:
    """CTEs that end in {table}_vector(i, v): the unit vector of greatest eigenvalue of a symmetric matrix (i, j, v), by squaring it.

    Its largest entry is positive.
    """
    return f"""
    {table}_power AS (
        SELECT i, j, v / max(abs(v)) OVER () AS v, 0 AS step FROM {table}
        UNION ALL
        SELECT i, j, v / max(abs(v)) OVER (), step FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v, any_value(a.step) + 1 AS step FROM {table}_power a JOIN {table}_power b ON a.j = b.i WHERE a.step < {steps} GROUP BY a.i, b.j)
    ),
    {table}_column AS (SELECT i, v FROM {table}_power WHERE step = {steps} AND j = (SELECT arg_max(j, v) FROM {table}_power WHERE step = {steps} AND i = j)),
    {table}_vector AS (SELECT i, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM {table}_column) AS v FROM {table}_column)"""
