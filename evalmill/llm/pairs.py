"""Broken prompt and response pairs, each with its types of defect.

Languages of prompts and replies are compared by the posteriors of character n-gram models; the end
of the reply is judged by the word runs of the corpus (see truncation); empty replies, refusals and
copies of the prompt are found in the reply's own text.

Defined cases: a NULL reply is empty; a NULL or blank prompt makes neither a copy nor another
language; replies of items without a row are not judged; repeated rows are judged each; a bare
answer value or a quotation does not make a language; texts are judged whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import languages, truncation

#: N-grams a reply must have to show a language, and the margin per n-gram over the prompt's.
MIN_GRAMS, MARGIN = 20, 0.4
#: The margin a reply must have in all, so that a few words decide nothing.
TOTAL_MARGIN = 18
#: Margin per n-gram up to which a language is plausible beside a prompt's best.
SURE = 0.3
#: Characters at the end that are searched for an answer first.
TAIL = 240
#: The same in all.
PROMPT_MARGIN = 30
#: Letters and digits a copy must have; less is an answer value that the prompt offers too.
MIN_COPY = 20
#: A prompt sent with an instruction of its arm is copied with it: so many letters and digits of the
#: item's own prompt, and this share of the reply, make a copy too.
LONG_COPY, COPIED_SHARE = 150, 0.75

#: Nothing but markup, labels or an answer marker without content.
EMPTY = (
    r"(?i)^(?:[^\p{L}\p{Nd}]|\\(?:boxed|text)|</?[a-z]+/?>|&[a-z]+;|(?:the |my )?(?:final )?(?:answer|result|output|response)|(?:meine |endgültige )?antwort|(?:mi )?respuesta(?: final)?"
    r"|(?:ma )?réponse(?: finale)?|(?:minha )?resposta(?: final)?|risposta(?: finale)?|итоговый ответ|ответ|最终答案|答案|boxed|n/?a|null|none|nan)*$"
)
#: The reply ends with an answer that has a value.
ANSWERED = (
    r"(?i)(?:\\boxed\{(?!\s*(?:n/?a|none|null|unknown|unclear|\?|-|\\text\{\s*\})?\s*\})[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[\s*_.$\p{Cf}]*"
    r"|(?:^|[\s*=:])(?:[01]?\.\d+|[01]|\d{1,3} ?%)[\s*_\p{Cf}]*)$"
)
_VERB = r"(?:speculate|take a position|provide a|predict|help (?:you |with)|assist|answer (?:this|that|the|your|such)|answer\b(?! the same)|give (?:a|an|any|you)|guess|discuss|comment|make a|offer a|engage)"
#: Ways to decline.
REFUSAL = (
    rf"(?i)\b(?:can(?:[’']|no)?t|can not|won[’']t|will not|unable to|not able to|(?:AI|language) model,? I (?:do not|don[’']t)|must (?:decline|refuse) to|have to (?:decline|refuse) to|decline to|not allow me to"
    rf"|appropriate for me to|prefer not to|rather not|not comfortable(?: to)?|not (?:permitted|allowed) to) {_VERB}"
    r"|\bno comment on\b|\brequest (?:was )?(?:declined|refused|denied)|outside (?:of )?what I can|off limits for me|leave the answer open|not something I can (?:help|answer|discuss)|i(?: have|[’']ll have) to pass\b"
    r"|kann ich (?:dabei |diese |dazu |zu dieser |hierzu |hier )?[^.]{0,30}?(?:keine Vorhersage|nicht (?:helfen|beantworten|sagen|dienen))|ich kann (?:dabei|diese|dazu|zu dieser|hierzu)[^.]{0,30}?(?:keine|nicht)\b|muss ich (?:leider )?ablehnen|möchte ich (?:mich )?(?:nicht|keine) |keine Angabe machen"
    r"|ne (?:peux|puis) pas (?:vous aider|répondre|donner|faire|traiter)|pas en mesure de (?:vous|répondre|donner|faire)|préfère ne pas|sort de ce que je peux|dois (?:refuser|décliner)"
    r"|no puedo (?:responder|ayudar|dar|hacer|ofrecer)|(?:debo|tengo que) (?:rechazar|declinar)|prefiero no |no me es posible|queda fuera de lo que puedo"
    r"|não posso (?:responder|ajudar|dar|fazer)|prefiro não|non posso (?:rispondere|aiutare|dare|fare)|preferisco non|не могу (?:ответить|помочь|дать)|无法(?:回答|提供|预测)|不能(?:回答|提供)"
)
_LABEL = r"(?i)^\W*(?:(?:the |your |this )?(?:prompt|question|task|request)(?: asked| was| reads| is)?(?: was)?|you asked|asked|(?:die |ihre )?frage|(?:la |su |votre )?(?:pregunta|question|demande)(?: est| es)?)\s*[:：]"


def _alnum(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "")


def _languages(df: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """key, the carried columns, grams and scores (log posterior per n-gram and language) of each row."""
    kinds = dict(df.dtypes)
    logp = df.sparkSession.sparkContext.broadcast(languages.model())  # fixed size: languages x buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, grams = languages.posteriors(b.column(b.num_columns - 1).to_pylist(), logp.value)
            flat = (scores / np.maximum(grams, 1)[:, None]).astype(np.float32).ravel()
            ends = pa.array(np.arange(len(grams) + 1, dtype=np.int32) * len(languages.LANGUAGES))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(grams.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(flat))],
                names=[key, *carry, "grams", "scores"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + ", grams int, scores array<float>"
    return df.select(key, *carry, text).mapInArrow(run, schema)


def prompt_languages(items: DataFrame) -> DataFrame:
    """item_id, prompt (letters and digits) and plausible (per language, whether the prompt may be in it).

    Plausible are the best language and those that the prompt does not set apart from it; a prompt of few n-grams has none.
    """
    one = items.groupBy("item_id").agg(F.min("prompt").alias("prompt"))
    scored = _languages(one.withColumn("text", F.col("prompt")), "item_id", "text", ["prompt"])
    near = F.transform("scores", lambda s: F.array_max("scores") - s <= F.greatest(F.lit(SURE), PROMPT_MARGIN / F.col("grams")))
    return scored.select("item_id", _alnum(F.col("prompt")).alias("prompt"), F.when(F.col("grams") >= MIN_GRAMS, near).alias("plausible"))


def defective_pairs(replies: DataFrame, items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(row_id, defect) for replies (row_id, item_id, text) to items (item_id, prompt).

    corpus: (row_id, text) of all replies, from which the ends of texts are learnt; it contains the
    replies judged.
    """
    bare = F.col("text").isNull() | F.col("text").rlike(EMPTY)
    # the last box is looked at as a whole, and of a text that ends with much markup all of it
    tail = F.when(F.right("text", F.lit(TAIL)).rlike(r"^[\s*_.$\p{Cf}]+$"), F.col("text")).otherwise(F.right("text", F.lit(TAIL)))
    box = F.concat(F.lit("\\boxed{"), F.substring_index("text", "\\boxed{", -1))
    answered = tail.rlike(ANSWERED) | (F.contains("text", F.lit("\\boxed{")) & (F.length(box) > TAIL) & box.rlike(ANSWERED))
    plain = replies.select("row_id", "item_id", "text").withColumn("bare", F.coalesce(bare, F.lit(True))).withColumn("open", ~F.col("bare") & ~answered)
    refused = F.when(F.col("open"), F.col("text").rlike(REFUSAL)).otherwise(False)
    pieces = F.filter(F.transform(F.split(F.col("text"), r"[\r\n]+"), lambda s: _alnum(F.regexp_replace(s, _LABEL, ""))), lambda s: s != "")
    flagged = plain.select(
        "row_id", "item_id", "bare", "open", refused.alias("refused"), F.when(~F.col("bare"), pieces).alias("pieces"),
        F.when(~F.col("bare"), F.col("text")).alias("text"),
    )
    scored = _languages(spread(flagged), "row_id", "text", ["item_id", "bare", "open", "refused", "pieces"])
    joined = scored.join(prompt_languages(items), "item_id")
    total = F.length(F.array_join("pieces", ""))
    repeated = F.aggregate("pieces", F.lit(0), lambda n, s: n + F.when(F.contains(F.col("prompt"), s), F.length(s)).otherwise(0))
    copies = ((total >= MIN_COPY) & (repeated == total)) | ((repeated >= LONG_COPY) & (repeated >= COPIED_SHARE * total))
    # what looks like an answer at the end is copied too if the prompt ends so, or if a long last line is the prompt's
    last = F.get("pieces", F.size("pieces") - 1)
    copied_end = F.endswith(F.col("prompt"), F.right(F.array_join("pieces", ""), F.lit(MIN_COPY))) | ((F.length(last) >= MIN_COPY) & F.contains(F.col("prompt"), last))
    copies &= F.col("open") | copied_end
    ahead = F.array_max("scores") - F.array_max(F.zip_with("scores", "plausible", lambda s, own: F.when(own, s)))
    other = (F.col("grams") >= MIN_GRAMS) & (ahead > MARGIN) & (ahead * F.col("grams") > TOTAL_MARGIN) & ~F.col("bare")
    cut = truncation.truncated_texts(corpus).select("row_id", F.lit(True).alias("cut"))
    judged = joined.withColumn("copies", F.coalesce(copies, F.lit(False))).join(cut, "row_id", "left")
    defects = F.array_compact(F.array(
        F.when(F.col("bare"), F.lit("empty")),
        F.when(F.col("cut"), F.lit("truncated")),
        F.when(F.col("refused"), F.lit("refusal")),
        F.when(F.col("copies"), F.lit("copies_question")),
        F.when(other & ~F.col("copies"), F.lit("other_language")),
    ))
    return judged.select("row_id", F.explode(defects).alias("defect"))
