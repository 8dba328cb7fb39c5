"""Parts of full-text search: words of texts, pages, near terms, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import osa_within

#: What parts terms: all but letters and digits of any script.
UNICODE = r"[^\p{L}\p{N}]+"


def tokens(text: Column, pattern: str = UNICODE) -> Column:
    """Lower-cased runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(text), pattern), lambda t: (t != "") & (F.octet_length(t) <= 40))


def top(scored: DataFrame, k: int, offset: int = 0) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").offset(offset).limit(k)


def fuzzy_terms(vocab: DataFrame, word: str, d: int = 1, *by: str) -> DataFrame:
    """Terms of the vocabulary (and the columns ``by``) within the distance of a word; lengths are compared before distances."""
    w = word.lower()
    near = vocab.where(F.length("term").between(len(w) - d, len(w) + d))
    return near.where(osa_within(F.col("term"), F.lit(w), d)).select(*by, "term")


def pack(results: DataFrame, budget: int) -> DataFrame:
    """Greedy packing of results (doc_id, score, snippet, summary) into a token budget, skipping what does not fit.

    ``results`` is a page of at most some hundred rows; the fold is sequential
    because a later, smaller item may still fit.
    """
    page = results.select(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "doc_id", F.coalesce("snippet", F.lit("")).alias("sn"), F.coalesce("summary", F.lit("")).alias("su")))).alias("xs"))
    return page.selectExpr(f"""explode(aggregate(xs, named_struct('left', cast({budget} as bigint), 'out', cast(array() as array<struct<doc_id:bigint, cost:bigint, mode:string>>)),
        (z, x) -> if(ceil((octet_length(x.sn) + octet_length(x.su)) / 4) <= z.left,
            named_struct('left', z.left - ceil((octet_length(x.sn) + octet_length(x.su)) / 4), 'out', concat(z.out, array(named_struct('doc_id', x.doc_id, 'cost', ceil((octet_length(x.sn) + octet_length(x.su)) / 4), 'mode', 'full')))),
            if(octet_length(x.su) > 0 and ceil(octet_length(x.su) / 4) <= z.left,
                named_struct('left', z.left - ceil(octet_length(x.su) / 4), 'out', concat(z.out, array(named_struct('doc_id', x.doc_id, 'cost', ceil(octet_length(x.su) / 4), 'mode', 'summary')))),
                z)), z -> z.out)) as r""").select("r.*")  # fmt: skip
