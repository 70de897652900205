r"""Text cut off by field limits, in SQL.

Every distinct text is split into sentences with digits and names made alike; equal sentences are counted
before anything else, so the trigram table is built from distinct sentences with their counts. A
trigram is counted inside (more words follow in its sentence) and at ends. The last trigram of a text
without a closing mark is joined to these counts: frequent inside but almost never at an end means
the text was cut. A last word that never stands there but begins words that do was cut inside the
word. Open answer markers, quotes and broken bytes at the end are exact signs.

Defined cases: NULL, blank and bare-label texts are not truncated (they are empty); repeated rows are
judged alike, each on its own, and count once; a text without evidence either way is not truncated; texts are read
whole whatever their length. Table sizes follow the number of distinct trigrams, not of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

#: Share of ends below which a trigram seen inside counts as almost never terminal.
END_SHARE = 0.05
#: Share of unmarked text ends that, when exceeded, shows that people do stop there.
STOP_SHARE = 0.2

#: Letters from which a word's beginnings are looked up one by one.
LONG_WORD = 64
#: Buckets of the fixed-size sets that tell which word runs can meet an end.
MEETING = 1 << 20

_SPACE = r"[\s\p{Z}\p{Cf}]"
_CUT_WORD = r"[a-z ]*(?:cut|truncat|snip|continu|omit)[a-z ]*"
#: Patterns of the SQL below, by parameter name.
PATTERNS = {
    # blanks and marks of omission after the end
    "tail": rf"(?i)(?:{_SPACE}|…|\.\.\.+|[\[(](?:…|\.\.+|{_CUT_WORD})[\])]|<{_CUT_WORD}>)+$",
    "may_tail": r"(?:[\s\p{Z}\p{Cf}…\])>]|\.\.\.)$",
    "digits": r"[0-9]+",
    # a name follows a lower-case word, a number or a comma; the blank comes first to find it fast
    "name": r" (?<=[\p{Ll}0,;:%)] )\p{Lu}[\p{L}'’]*(?: \p{Lu}[\p{L}'’]*)*",
    "bound": r"[.!?:](?=[\s*_\"')\]}”»])|[。！？\r\n]+",
    "closed": r"(?:[.!?。！？][*_\"'”“»)\]}`]*|(?:[.!?:。！？]\s+|\n|^|\*|=\s*)(?:0\.[0-9][0-9]|[0-9]{1,3}%)\**)$",
    "closers": r"^[*_\"'”“»)\]}`]+$",  # the end of the sentence lies before them
    "may_boxed": r"[}*_$]",
    "boxed": r"\\boxed\{(?:[^{}]|\{[^{}]*\})*\}[*_$\s]*$",
    "edge": r"^[^\p{L}\p{Nd}%<]+|[^\p{L}\p{Nd}%>]+$",
    "han": r"\p{IsHan}",
    # a label with nothing after it, and whatever else is no text
    "bare": r"(?i)^(?:[^\p{L}\p{Nd}]|boxed|think|answer|nbsp|br|text|final|endg[uü]ltige|meine|my|ma|mi|respuesta|r[ée]ponse|antwort|finale?|risposta|resposta|result|output|null|none)*$",
    # signs at the end that no whole text has: broken bytes, an open marker or quote, the start of a
    # list entry, a probability cut after its point
    "open": r"(?s)(?:\x{FFFD}|\\boxed\{(?:[^{}]|\{[^{}]*\})*(?:\{[^{}]*)?|\\bo?x?e?d?|\n[-•*]|[,;]|[„«][^“”»\"]*"
            r"|(?i)(?:(?:answer|antwort|respuesta|réponse|risposta|resposta|ответ|答案)\s*[:：]\s*\**(?:0?\.?)|(?:my|final|meine|mi|ma) (?:answer|antwort|respuesta|réponse)|(?:so i choose|i settle on|p =)\s*\**(?:0?\.?)))$",
    # those of the open signs that a point can end, for texts that seem closed by it
    "cut_value": r"(?i)(?:(?:answer|antwort|respuesta|réponse|risposta|resposta|ответ|答案)\s*[:：]|\b(?:so i choose|i settle on|p =))\s*\**0?\.$",
    "cut_item": r"\n[0-9]+\.$",
    "pointed": r"[.!?。！？]$",
    "open_box": r"\\boxed\{(?:[^{}]|\{[^{}]*\})*(?:\{[^{}]*)?$",
    # an opening quote follows a blank; « after a letter closes one in German
    "open_quote": r"(?:^|[\s(])[„«][^“”»\"\n]*$",
    "capital": r"\p{Lu}[\p{L}'’]*",
    "last_word": r"\p{L}+$",
    "last_name": r"(\p{Lu}[\p{L}'’]*)\P{L}*$",
    "item": r"(?:^|\n)(\d+)\. [^\n]*\n+(\d+)\.?$",
}


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text, args={k: v for k, v in PATTERNS.items() if re.search(rf":{k}\b", text)}, **tables)


def _sentences(text: str) -> str:
    return f"split(regexp_replace(regexp_replace({text}, :digits, '0'), :name, ' N'), :bound)"


def _words(sentence: str) -> str:
    spaced = f"regexp_replace(lower({sentence}), :han, ' $0 ')"
    return f"filter(transform(split({spaced}, '[[:space:]]+'), w -> regexp_replace(w, :edge, '')), w -> w <> '')".replace("[[:space:]]", "[ \\\\t\\\\x0B\\\\f]")


def _begun(spark: SparkSession, place: str, word: str, total: str, words: DataFrame, ends: DataFrame, where: str = "true") -> DataFrame:
    """place, word, longer: per place and beginning of a word, the total over the longer words there that begin so.

    Beginnings shorter than LONG_WORD come from every word; longer ones, as of encoded data, only where an
    end is one, by their first LONG_WORD letters, so a long word gives no more rows than a short one.
    """
    at = f"{place}, " if place else ""
    on = " and ".join([f"e.{c.strip()} = t.{c.strip()}" for c in place.split(",") if c.strip()] + [f"left(e.{word}, {LONG_WORD}) = left(t.{word}, {LONG_WORD})"])
    of_end = "".join(f"e.{c.strip()}, " for c in place.split(",") if c.strip())
    return _sql(
        spark,
        f"""
        select {at}left({word}, k) as {word}, {total} as longer
        from {{words}} lateral view explode(sequence(1, least({LONG_WORD} - 1, length({word}) - 1))) as k where length({word}) > 1 and {where}
        group by all
        union all
        select {of_end}e.{word}, {total} as longer
        from (select distinct {at}{word} from {{ends}} where length({word}) >= {LONG_WORD}) e
        join (select * from {{words}} where length({word}) > {LONG_WORD} and {where}) t on {on} and length(t.{word}) > length(e.{word}) and startswith(t.{word}, e.{word})
        group by all""",
        words=words, ends=ends,
    )


def truncated_texts(rows: DataFrame) -> DataFrame:
    """row_id of the truncated rows of (row_id, text)."""
    spark, rows = rows.sparkSession, rows.select("row_id", "text")
    # lateral views keep costly expressions from being copied into every place that uses them; outer
    # ones where the optimizer would else evaluate the exploded expression once more in a filter
    bodies = _sql(
        spark,
        """
        select row_id, body, if(right(body, 24) rlike :closers, body, right(body, 24)) rlike :closed or (right(body, 1) rlike :may_boxed and body rlike :boxed) as closed
        from {rows} lateral view explode(array(if(right(text, 3) rlike :may_tail, regexp_replace(text, :tail, ''), text))) as body where text is not null""",
        rows=rows,
    )
    # 1. distinct sentences and names with their counts over distinct texts, as copies of one cut text
    # would else vouch for its end; the unmarked last piece of a text is kept apart
    texts = _sql(spark, "select distinct body, closed from {bodies}", bodies=bodies)
    pieces = _sql(
        spark,
        f"""
        select s, kind, count(*) as n from (
            select trim(s) as s, case when i >= size(ss) then 'name' when i = size(ss) - 1 and not closed then 'stop' else 'inside' end as kind
            from (
                select {_sentences('body')} as ss, regexp_extract_all(if(closed, body, regexp_replace(body, :last_word, '')), :capital, 0) as names, closed from {{texts}})
            lateral view outer posexplode(concat(ss, names)) as i, s
        ) where s <> '' group by s, kind""",
        texts=texts,
    )
    pieces = cut_lineage(pieces)
    counted = _sql(spark, "select s, kind = 'stop' as stop, n from {pieces} where kind <> 'name'", pieces=pieces)
    # 2. last pieces of the texts that do not close, and texts closed by a point that an exact sign shows to be cut;
    # most texts fail the tests of their last characters, which come first
    item = "coalesce(try_cast(regexp_extract(body, :item, 1) as bigint) + 1 = try_cast(regexp_extract(body, :item, 2) as bigint), false)"
    signs = rf"""(right(body, 1) rlike :pointed and (right(body, 40) rlike :cut_value or right(body, 12) rlike :cut_item and {item}
        or contains(body, '\\boxed{{{{') and body rlike :open_box or (contains(body, '„') or contains(body, '«')) and body rlike :open_quote))"""
    last = _sql(
        spark,
        f"""
        select row_id, exact, concat_ws(' ', get(pp, size(pp) - 5), get(pp, size(pp) - 4)) as w0, get(pp, size(pp) - 3) as w1, get(pp, size(pp) - 2) as w2,
               if(size(pp) > 4 and not closed, get(pp, size(pp) - 1), null) as w3, name
        from (
            select row_id, closed, nullif(regexp_extract(body, :last_name, 1), '') as name, {_sentences('body')} as ss,
                   closed or body rlike :open or {item} as exact
            from {{bodies}} where (not closed or {signs}) and not body rlike :bare)
        lateral view explode(array(concat(array('^', '^', '^', '^'), {_words('element_at(ss, -1)')}))) as pp""",
        bodies=bodies,
    )
    last = cut_lineage(last)
    ends = _sql(spark, "select distinct w0, w1, w2, w3, if(w3 = 'n', name, null) as name from {last} where w3 is not null", last=last)
    # 3. word runs inside and at ends: trigrams, and runs of five where there is such a history. Only runs that can
    # meet an end are exchanged: those after its last word but one and with its first letter, or equal to it
    near = _sql(spark, f"select distinct pmod(xxhash64(w2, left(w3, 1)), {MEETING}) as bucket from {{ends}}", ends=ends)
    same = _sql(spark, f"select distinct pmod(xxhash64(w0, w1, w2, w3), {MEETING}) as bucket from {{ends}}", ends=ends)
    runs = _sql(
        spark,
        f"""
        select /*+ broadcast(m) */ w1, w2, w3, if(long, w0, null) as w0, sum(if(not last, n, 0)) as inside, sum(if(last and not stop, n, 0)) as ends, sum(if(last and stop, n, 0)) as stops
        from (
            select n, stop, long, get(pp, i - 2) as w1, get(pp, i - 1) as w2, get(pp, i) as w3, concat_ws(' ', get(pp, i - 4), get(pp, i - 3)) as w0, i = size(pp) - 1 as last
            from {{counted}}
            lateral view explode(array(concat(array('^', '^', '^', '^'), {_words('s')}))) as pp
            lateral view explode(sequence(4, greatest(4, size(pp) - 1))) as i
            lateral view explode(array(true, false)) as long
            where size(pp) > 4) r
        left semi join (select bucket, false as long from {{near}} union all select bucket, true from {{same}}) m
            on m.long = r.long and m.bucket = pmod(if(r.long, xxhash64(w0, w1, w2, w3), xxhash64(w2, left(w3, 1))), {MEETING})
        group by 1, 2, 3, 4""",
        counted=counted, near=near, same=same,
    )
    runs = cut_lineage(runs)  # read several times below
    grams = _sql(spark, "select w1, w2, w3, inside, ends, stops from {runs} where w0 is null", runs=runs)
    fives = _sql(spark, "select w0, w1, w2, w3, inside, ends from {runs} where w0 is not null", runs=runs)
    # 4. how many occurrences a word cut short could stand for, in its place
    begun = _begun(spark, "w1, w2", "w3", "sum(inside + ends)", grams, ends, "inside + ends > 0")
    pairs = _sql(spark, "select w2, w3, sum(inside) as inside, sum(ends) as ends from {grams} group by 1, 2", grams=grams)
    begun_pairs = _begun(spark, "w2", "w3", "sum(inside + ends)", pairs, ends)
    # names are alike in the runs; their own spelling tells whether one was cut inside
    names = _sql(spark, "select s as w, n from {pieces} where kind = 'name'", pieces=pieces)
    cut_names = _begun(spark, "", "w", "sum(n)", names, _sql(spark, "select name as w from {ends} where name is not null", ends=ends))
    judged = _sql(
        spark,
        f"""
        select e.*,
            case when v.w is not null and v.n >= 3 then false else coalesce(c.longer > 3 * coalesce(v.n, 0), false) end
            or case when f.inside + f.ends >= 2 then f.ends < {END_SHARE} * f.inside
                 when g.inside + g.ends > 0 then g.ends < {END_SHARE} * (g.inside + coalesce(b.longer, 0)) and g.stops < {STOP_SHARE} * (g.inside + coalesce(b.longer, 0)) + 1.5
                 when b.longer > 0 then coalesce(g.stops, 0) < {STOP_SHARE} * b.longer + 1.5
                 when p.inside + p.ends > 0 then p.ends < {END_SHARE} * p.inside and coalesce(g.stops, 0) < 3
                 else coalesce(q.longer > 3 * coalesce(g.stops, 0), false) end as cut
        from {{ends}} e
        left join {{fives}} f on f.w0 = e.w0 and f.w1 = e.w1 and f.w2 = e.w2 and f.w3 = e.w3
        left join {{grams}} g on g.w1 = e.w1 and g.w2 = e.w2 and g.w3 = e.w3
        left join {{begun}} b on b.w1 = e.w1 and b.w2 = e.w2 and b.w3 = e.w3
        left join {{pairs}} p on p.w2 = e.w2 and p.w3 = e.w3
        left join {{begun_pairs}} q on q.w2 = e.w2 and q.w3 = e.w3
        left join {{names}} v on v.w = e.name
        left join {{cut_names}} c on c.w = e.name""",
        ends=ends, fives=fives, grams=grams, begun=begun, pairs=pairs, begun_pairs=begun_pairs, names=names, cut_names=cut_names,
    )
    by_trigram = _sql(
        spark,
        "select l.row_id from {last} l join {judged} j on l.w0 = j.w0 and l.w1 = j.w1 and l.w2 = j.w2 and l.w3 = j.w3 and if(l.w3 = 'n', l.name, null) <=> j.name where j.cut",
        last=last, judged=judged,
    )
    exact = _sql(spark, "select row_id from {last} where exact", last=last)
    return _sql(spark, "select row_id from {a} union select row_id from {b}", a=by_trigram, b=exact)


def truncation_rates(rows: DataFrame) -> DataFrame:
    """source, n_texts, n_truncated and truncated_share of (row_id, source, text); NULL sources are one group.

    Partial sums per source are taken before the exchange, so a source holding most rows costs no more.
    """
    cut = truncated_texts(rows.select("row_id", "text"))
    return _sql(
        rows.sparkSession,
        """
        select source, count(*) as n_texts, count_if(cut) as n_truncated, count_if(cut) / count(*) as truncated_share
        from (select r.source, c.row_id is not null as cut from {rows} r left join {cut} c on r.row_id = c.row_id where r.text is not null)
        group by source""",
        rows=rows.select("row_id", "source", "text"), cut=cut,
    )
