"""DuckDB SQL with the same result as each registered query."""

from __future__ import annotations

# --- inputs, as in askgrid.plans.views -----------------------------------------------------
RESULTS = """
results as (
  select d.doc_id as row_id,
         case when d.doc_id % 2 = 0 then 'model_a' else 'model_b' end as model,
         trim(concat(' ', d.lang, ' ')) as document_type,
         case when l.quality = 1 then 'Positive' else 'Negative' end as question_type,
         1 + d.n_chars % 10 as correctness,
         case when d.doc_id % 4 = 0 then 0 else 1 + d.doc_id % 10 end as retrieval,
         case when d.doc_id % 4 = 0 then 0 else 1 + d.doc_id % 7 end as groundedness,
         d.doc_id % 4 <> 0 and d.doc_id % 3 <> 0 as document_match
  from documents d join labels l on d.doc_id = l.doc_id
  where l.toxic = 0
)"""

LISTING = """
listing as (
  select doc_id,
         case when doc_id % 17 = 0 then null
              when doc_id % 7 = 0 then concat('CCS ', doc_id)
              when doc_id % 11 = 0 then concat('Market Strategy ', doc_id)
              when doc_id % 13 = 0 then concat(source, ' Market Summary ', doc_id)
              when doc_id % 10 = 0 then concat('Fact/Sheet ', doc_id)
              else concat('Fact Sheet ', doc_id) end as name,
         concat('/files/v1.2/', doc_id,
                case when doc_id % 5 = 0 then '.docx' when doc_id % 9 = 0 then '' else '.pdf' end) as url,
         concat('n', n_chars) as modification_date
  from documents
), kept as (
  select * from listing
  where name is null
     or not (starts_with(name, 'CCS') or contains(name, 'Market Strategy') or contains(name, 'Market Summary'))
), stored as (
  select concat(case when doc_id % 3 = 0 then 'Fact Sheet ' else 'Archive ' end, doc_id,
                case when doc_id % 8 = 1 then '.docx' else '.pdf' end) as file_name
  from documents
), fresh as (
  select * from kept
  where name is not null and not exists (select 1 from stored s where s.file_name = concat(kept.name, '.pdf'))
)"""

_MEANS = ", ".join(
    f"round_even(avg({m}) * 100, 0) / 100 as {m}" for m in ("correctness", "retrieval", "groundedness")
)


def _scores(question_type: str) -> str:
    return f"""with {RESULTS}
select document_type, {_MEANS} from results
where question_type = '{question_type}' and document_type is not null group by document_type"""


_ERROR = """round(avg(correctness), 6) as mean_correctness,
       round(stddev_samp(correctness) / sqrt(count(correctness)), 6) as standard_error,
       count(correctness) as n"""
_ORDERS = """cast(list_position(['en', 'de', 'es', 'fr'], document_type) as integer) as document_type_order,
       cast(list_position(['Positive', 'Negative'], question_type) as integer) as question_type_order"""

SUMMARY = {
    "pos_scores_by_doctype": _scores("Positive"),
    "neg_scores_by_doctype": _scores("Negative"),
    "pct_match": f"""with {RESULTS}, shares as (
  select model, question_type, document_type,
         round_even(avg(cast(document_match as integer)) * 100 * 100, 0) / 100 as percentage_match
  from results group by all)
select *, case when percentage_match > 0 then printf('%.1f%%', percentage_match) end as label, {_ORDERS} from shares""",
    "response_counts": f"""with {RESULTS}
select count(*) as total, count(*) filter (model = 'model_a') as model_a,
       count(*) filter (model = 'model_b') as model_b,
       count(*) filter (question_type = 'Positive') as positive,
       count(*) filter (question_type = 'Negative') as negative from results""",
    "correctness_se_by_model": f"with {RESULTS} select model, {_ERROR} from results group by model",
    "correctness_se_by_facet": f"""with {RESULTS}
select question_type, document_type, model, {_ERROR}, {_ORDERS} from results group by all""",
    "correctness_hist": f"""with {RESULTS}, spans as (
  select question_type, document_type, count(*) as n, cast(min(correctness) as double) as low,
         cast(max(correctness) - min(correctness) as double) as span,
         quantile_cont(correctness, 0.75) - quantile_cont(correctness, 0.25) as iqr
  from results group by all
), widths as (
  select *, least(greatest(2.0 * iqr / pow(n, 1.0 / 3.0), span / sqrt(n) / 2), span / (log2(n) + 1)) as width
  from spans
), bins as (
  select *, cast(case when span = 0 then 1 else ceil(span / width) end as integer) as bins from widths
), placed as (
  select r.question_type, r.document_type, b.bins, b.low, b.span, b.n,
         cast(case when b.span = 0 then 0
                   else least(floor((r.correctness - b.low) * b.bins / b.span), b.bins - 1) end as integer) as bin
  from results r join bins b on r.question_type = b.question_type and r.document_type = b.document_type
)
select question_type, document_type, bin, bins,
       round(case when span = 0 then low - 0.5 + bin else low + bin * (span / bins) end, 6) as bin_start,
       count(*) as count, round(count(*) * 100.0 / n, 6) as percent
from placed group by question_type, document_type, bin, bins, low, span, n""",
    "docmatch_hist": f"""with {RESULTS}
select question_type, document_type, case when document_match then 'True' else 'False' end as document_match,
       case when document_match then 0 else 1 end as match_order, count(*) as count,
       round(count(*) * 100.0 / sum(count(*)) over (partition by question_type, document_type), 6) as percent
from results group by question_type, document_type, results.document_match""",
    "model_union": """
select d.doc_id as row_id, case when d.doc_id % 2 = 0 then 'model_a' else 'model_b' end as model,
       cast(1 + d.n_chars % 10 as integer) as correctness,
       cast(case when d.doc_id % 2 = 0 then null when d.doc_id % 4 = 0 then 0 else 1 + d.doc_id % 7 end as integer)
         as groundedness
from documents d left join labels l on d.doc_id = l.doc_id""",
}

DOCUMENTS = {
    "listing_parse": f"""with {LISTING}
select name, url, modification_date from listing where doc_id % 19 <> 0""",
    "listing_rejects": """
select doc_id, 401 as status, 'denied' as status_text, 'status' as reason
from documents where doc_id % 19 = 0""",
    "doc_exclusion_filter": f"with {LISTING} select doc_id, name, url from kept",
    "doc_exclusion_count": f"with {LISTING} select count(*) as documents from kept",
    "new_docs": f"with {LISTING} select name from fresh",
    "new_docs_stream": f"with {LISTING} select doc_id, name, url from fresh",
    "new_docs_by_target": f"""with {LISTING}
select name from kept where name is not null and not exists (
  select 1 from stored s
  where s.file_name = concat(replace(kept.name, '/', ''), '.', split_part(split_part(kept.url, '/', -1), '.', -1)))""",
    "download_plan": f"""with {LISTING}
select doc_id, name, url,
       concat('raw_docs/', replace(name, '/', ''), '.', split_part(split_part(url, '/', -1), '.', -1)) as target
from fresh""",
    "orphan_docs": f"""with {LISTING}
select file_name from stored s
where not exists (select 1 from kept where concat(kept.name, '.pdf') = s.file_name)""",
    "drop_empty_columns": "select doc_id, lang, case when doc_id = 0 then 'x' end as rare, text from documents",
    "schema_contract": """
select 'documents' as table_name, false as has_vector, true as has_content, false as compatible,
       count(*) as rows, 0 as filled_rows from documents
union all
select 'embeddings', true, true, true, count(*), count(*) filter (embedding is not null and label is not null)
from embeddings""",
}


# --- retrieval -----------------------------------------------------------------------------
def _vector(alias: str, key: str, text: str, table: str) -> str:
    """Unit vector of 64 hashed word counts per row of a table."""
    return f"""
{alias}_words as (
  select {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) as word
  from {table}
), {alias}_places as (
  select {key}, cast(concat('0x', substr(md5(word), 1, 8)) as bigint) % 64 as place, count(*) as n
  from {alias}_words group by all
), {alias}_lengths as (
  select {key}, sqrt(cast(sum(n * n) as double)) as length from {alias}_places group by all
), {alias}_weights as (
  select p.{key}, p.place, cast(p.n / l.length as float) as weight
  from {alias}_places p join {alias}_lengths l on p.{key} = l.{key}
), {alias}_vectors as (
  select r.{key}, coalesce(v.vector, list_transform(range(64), lambda i: cast(0 as float))) as vector
  from {table} r left join (
    select {key}, list_transform(range(64), lambda i: coalesce(map_extract(m, i)[1], cast(0 as float))) as vector
    from (select {key}, map_from_entries(list((place, weight))) as m from {alias}_weights group by all)
  ) v on r.{key} = v.{key}
)"""


CHUNKS = """
pieces as (
  select doc_id, concat(source, '.pdf') as title, lang, text,
         unnest(range(greatest(cast(ceil((length(text) - 500) / 1500.0) as bigint), 1))) as chunk_no
  from documents where length(text) > 0
), chunks as (
  select concat(doc_id, ':', chunk_no) as chunk_id, doc_id, title, lang, cast(chunk_no as integer) as chunk_no,
         substr(text, chunk_no * 1500 + 1, 2000) as chunk
  from pieces
), questions as (select item_id as question_id, text as question from benchmark)"""

_COSINE = """case when list_sum(list_transform({a}, lambda x: abs(x))) = 0 or list_sum(list_transform({b}, lambda x: abs(x))) = 0
            then 0 else round(list_cosine_similarity(cast({a} as double[]), cast({b} as double[])), 9) end"""

VECTOR_RANKS = f"""
{_vector("c", "chunk_id", "chunk", "chunks")}, {_vector("q", "question_id", "question", "questions")},
pairs as (
  select q.question_id, c.chunk_id, {_COSINE.format(a="q.vector", b="c.vector")} as score
  from q_vectors q cross join c_vectors c
), vector_ranks as (
  select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank
  from pairs qualify rank <= 5
)"""

TEXT_RANKS = """
lengths as (
  select c.chunk_id, count(w.word) as length from chunks c left join c_words w on c.chunk_id = w.chunk_id group by all
), totals as (select count(*) as n, avg(length) as mean_length from lengths),
frequencies as (select chunk_id, word, count(*) as f from c_words group by all),
rarity as (
  select word, ln(1 + ((select n from totals) - count(*) + 0.5) / (count(*) + 0.5)) as idf from frequencies group by word
), asked as (select question_id, word, count(*) as f from q_words group by all),
text_scores as (
  select a.question_id, t.chunk_id,
         round(sum(a.f * r.idf * t.f / (t.f + 1.2 * (0.25 + 0.75 * l.length / (select mean_length from totals)))), 9) as score
  from asked a join rarity r on a.word = r.word join frequencies t on a.word = t.word
  join lengths l on l.chunk_id = t.chunk_id group by all
), text_ranks as (
  select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from text_scores
)"""

RETRIEVAL = {
    "build_chunks": f"with {CHUNKS} select chunk_id, doc_id, title, lang, chunk_no, chunk from chunks",
    "embed_text": f"""with {CHUNKS}, {_vector("q", "question_id", "question", "questions")}
select question_id, cast(place as integer) as place, weight from q_weights""",
    "retrieve_topk": """
with pairs as (
  select q.vec_id as question_id, c.vec_id as chunk_id,
         round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 9) as score
  from embeddings q cross join embeddings c
)
select question_id, cast(row_number() over (partition by question_id order by score desc, chunk_id) as integer) as rank,
       chunk_id, score
from pairs qualify rank <= 5""",
    "retrieve_chunks": f"""with {CHUNKS}, {VECTOR_RANKS}
select r.question_id, cast(r.rank as integer) as rank, r.chunk_id, r.score, c.title, c.chunk
from vector_ranks r join chunks c on r.chunk_id = c.chunk_id""",
    "retrieve_text": f"""with {CHUNKS}, {_vector("c", "chunk_id", "chunk", "chunks")},
{_vector("q", "question_id", "question", "questions")}, {TEXT_RANKS}
select question_id, cast(rank as integer) as rank, chunk_id, score from text_ranks where rank <= 5""",
    "retrieve_hybrid": f"""with {CHUNKS}, {VECTOR_RANKS}, {TEXT_RANKS}, fused as (
  select coalesce(v.question_id, t.question_id) as question_id, coalesce(v.chunk_id, t.chunk_id) as chunk_id,
         coalesce(cast(1 as double) / (60 + v.rank), 0) + coalesce(cast(1 as double) / (60 + t.rank), 0) as score
  from vector_ranks v full join text_ranks t
    on v.question_id = t.question_id and v.chunk_id = t.chunk_id
)
select question_id, cast(row_number() over (partition by question_id order by score desc, chunk_id) as integer) as rank,
       chunk_id, round(score, 9) as score
from fused qualify rank <= 5""",
}


# --- conversations -------------------------------------------------------------------------
MESSAGES = """
messages as (
  select concat('session', conv_id % 4) as session_id, cast(conv_id as varchar) as thread_id, conv_id, turn,
         case when role = 'user' then 'human' when role = 'system' then 'system'
              when (conv_id + turn) % 3 = 0 then 'tool' else 'ai' end as type,
         text as content,
         role = 'assistant' and (conv_id + turn) % 3 = 1 as calls,
         case when role = 'assistant' and (conv_id + turn) % 3 = 0 and turn % 4 <> 3 then string_split(text, chr(10))
              else [] end as artifact
  from conversations
), named as (
  select *, list_transform(artifact, lambda x, i: concat('src', (conv_id + ((i - 1) * (i - 1)) % 7) % 23, '.pdf')) as names
  from messages
), ends as (
  select thread_id, max(turn) filter (type = 'tool') as last_tool, max(turn) filter (type <> 'tool') as last_other
  from messages group by thread_id
), run as (
  select m.* from messages m join ends e on m.thread_id = e.thread_id
  where m.type = 'tool' and (e.last_other is null or m.turn > e.last_other)
)"""

_LAST_SOURCES = """select thread_id, coalesce(arg_max(names, turn) filter (type = 'tool'{where}), []) as source_names,
         coalesce(arg_max(artifact, turn) filter (type = 'tool'{where}), []) as source_contents
  from {source} group by thread_id"""


def _last_sources(source: str, where: str = "") -> str:
    return f"""select thread_id, array_to_string(source_names, '|') as source_names,
       array_to_string(source_contents, '|') as source_contents
from ({_LAST_SOURCES.format(source=source, where=where)})"""


CONTEXTS = """
found as (
  select r.question_id, r.rank, c.title, c.lang, c.chunk from vector_ranks r join chunks c on r.chunk_id = c.chunk_id
), contexts as (
  select question_id, string_agg(chunk, chr(10) || chr(10) order by rank) as joined,
         string_agg(concat('Source: {''title'': ''', title, ''', ''lang'': ''', lang, '''}', chr(10), 'Content: ', chunk),
                    chr(10) || chr(10) order by rank) as serialised,
         list(title order by rank) as titles, list(chunk order by rank) as texts
  from found group by question_id
)"""

_INSTRUCTION = (
    "You are an assistant for question-answering tasks.Use the following pieces of retrieved context to "
    "answerthe question. If you don''t know the answer, say that youdon''t know. Use three sentences maximum "
    "and keep theanswer concise."
)

CONVERSATIONS = {
    "context_serialize": f"with {CHUNKS}, {VECTOR_RANKS}, {CONTEXTS} select question_id, joined, serialised from contexts",
    "prompt_build": f"""with {MESSAGES}
select thread_id, cast(-1 as bigint) as place, cast(-1 as bigint) as part, 'system' as type,
       concat('{_INSTRUCTION}', case when last_tool is not null and (last_other is null or last_tool > last_other)
                                     then '' else chr(10) || chr(10) end) as text
from ends
union all
select thread_id, -1, turn, 'system', concat(chr(10), chr(10), content) from run
union all
select thread_id, turn, -1, type, content from messages where type in ('human', 'system') or (type = 'ai' and not calls)""",
    "conversation_filter": f"""with {MESSAGES} select thread_id, turn, type, content from messages
where type in ('human', 'system') or (type = 'ai' and not calls)""",
    "turn_routing": f"""with {MESSAGES}
select thread_id, case when arg_max(calls, turn) then 'tools' else 'end' end as route from messages group by thread_id""",
    "trailing_tool_run": f"with {MESSAGES} select thread_id, turn, content from run",
    "last_answer": f"""with {MESSAGES}
select thread_id, count(*) as messages, arg_max(content, turn) as answer from messages group by thread_id""",
    "last_turn_sources": f"with {MESSAGES} {_last_sources('named')}",
    "last_turn_sources_in_turn": f"""with {MESSAGES}, asked as (
  select *, max(case when type = 'human' then turn end) over (partition by thread_id) as last_human from named
) {_last_sources('asked', " and (last_human is null or turn > last_human)")}""",
    "conversation_state_stream": f"""with {MESSAGES}, sources as ({_LAST_SOURCES.format(source='named', where='')})
select session_id, m.thread_id, count(*) as messages, max(turn) as last_turn, arg_max(content, turn) as answer,
       array_to_string(any_value(source_names), '|') as source_names,
       array_to_string(any_value(source_contents), '|') as source_contents
from messages m join sources s on m.thread_id = s.thread_id group by session_id, m.thread_id""",
    "conversation_steps_stream": f"""with {MESSAGES}
select session_id, thread_id, turn, row_number() over w as messages, turn as last_turn, content as answer,
       coalesce(array_to_string(last_value(case when type = 'tool' then names end ignore nulls) over w, '|'), '') as source_names,
       coalesce(array_to_string(last_value(case when type = 'tool' then artifact end ignore nulls) over w, '|'), '') as source_contents
from named window w as (partition by thread_id order by turn rows between unbounded preceding and current row)""",
    "thread_history_stream": f"""with {MESSAGES}
select session_id, thread_id, count(*) as messages, max(turn) as last_turn,
       string_agg(concat(type, ': ', content), chr(10) order by turn) as history
from messages where type in ('human', 'system') or (type = 'ai' and not calls) group by session_id, thread_id""",
    "format_sources": f"""with {MESSAGES}, urls as (
  select concat(source, '.pdf') as file_name, concat('https://docs.example/', min(doc_id)) as file_url
  from documents group by source
), cited as (
  select thread_id, turn, unnest(names) as name, unnest(range(len(names))) as pos from named
), firsts as (
  select thread_id, turn, name, min(pos) as pos from cited group by all
), links as (
  select f.*, case when u.file_url is null then name else concat('[', name, '](', u.file_url, ')') end as link,
         row_number() over (partition by thread_id, turn order by pos) as place
  from firsts f left join urls u on f.name = u.file_name
), blocks as (
  select thread_id, turn,
         concat('**Most Relevant Document:**', chr(10), '- ', max(link) filter (place = 1),
                coalesce(concat(chr(10), chr(10), '**Other Related Documents:**', chr(10))
                         || string_agg('- ' || link, chr(10) order by pos) filter (place > 1), '')) as sources
  from links group by all
)
select m.thread_id, m.turn, b.sources from messages m left join blocks b on m.thread_id = b.thread_id and m.turn = b.turn""",
}

# --- scores --------------------------------------------------------------------------------
ANSWERS = """
answers as (
  select u.conv_id, u.turn, u.text as question, coalesce(a.text, '') as answer, coalesce(d.text, '') as true_answer,
         coalesce(d.source, 'none') as file, d.source, l.quality,
         case when l.quality is null then [] else string_split(d.text, chr(10)) end as retrieved_contents
  from conversations u
  left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  left join documents d on d.doc_id = u.conv_id left join labels l on l.doc_id = u.conv_id
  where u.role = 'user'
)"""


def _words(text: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
    )


def _one_to_ten(share: str) -> str:
    return f"cast(1 + floor(coalesce({share}, 0.0) * 9 + 0.5) as integer)"


def _share(text: str, context: str) -> str:
    return f"cast(len(list_intersect({text}, {context})) as double) / nullif(len({text}), 0)"


def _measures(source: str) -> str:
    """Scores of `source`: question, answer, true_answer, file, first_name, contents, retrieved."""
    f1 = "len(list_intersect(a_words, t_words)) * 2 / cast(nullif(len(a_words) + len(t_words), 0) as double)"
    return f"""
worded as (
  select *, {_words("question")} as q_words, {_words("answer")} as a_words, {_words("true_answer")} as t_words,
         {_words("array_to_string(contents, chr(10))")} as c_words
  from {source}
), rated as (
  select *, {_one_to_ten(f1)} as correctness, {_one_to_ten(_share("q_words", "c_words"))} as retrieval_any,
         {_one_to_ten(_share("a_words", "c_words"))} as groundedness_any
  from worded
), measured as (
  select *, case when retrieved then retrieval_any else 0 end as retrieval,
         case when retrieved then groundedness_any else 0 end as groundedness,
         coalesce(nfc_normalize(first_name) = nfc_normalize(file), false) as document_match
  from rated
)"""


SCORED = f"""{ANSWERS}, named_answers as (
  select *, retrieved_contents as contents, quality is not null as retrieved,
         case when quality = 1 then source when quality = 0 then concat('not ', source) end as first_name
  from answers
), {_measures("named_answers")}"""

_ESCAPED = r"replace(replace(replace(x, '\', '\\'), chr(13), '\r'), chr(9), '\t')"
_LITERAL = rf"""case when contains(x, '''') and not contains(x, '"') then concat('"', {_ESCAPED}, '"')
          else concat('''', replace({_ESCAPED}, '''', '\'''), '''') end"""
_LISTED = f"concat('[', array_to_string(list_transform(retrieved_contents, lambda x: {_LITERAL}), ', '), ']')"

SCORES = {
    "docname_cleanup": f"""with {ANSWERS}
select conv_id, turn, case when quality = 1 then concat(source, '|not ', source)
                           when quality = 0 then concat('not ', source, '|', source) else '' end as names
from answers""",
    "doc_match": f"with {SCORED} select conv_id, turn, document_match from measured",
    "score_parse": """
select doc_id, cast(case when n_chars % 14 between 1 and 10 then n_chars % 14 end as integer) as score from documents""",
    "judge_correctness": f"with {SCORED} select conv_id, turn, correctness from measured",
    "judge_retrieval": f"with {SCORED} select conv_id, turn, retrieval_any as retrieval from measured",
    "judge_groundedness": f"with {SCORED} select conv_id, turn, groundedness_any as groundedness from measured",
    "eval_scores": f"""with {SCORED}
select conv_id, turn, correctness, retrieval, groundedness, document_match from measured""",
    "eval_no_retrieval_defaults": f"""with {SCORED}
select retrieved, count(*) as answers, cast(sum(correctness) as bigint) as correctness,
       cast(sum(retrieval) as bigint) as retrieval, cast(sum(groundedness) as bigint) as groundedness,
       count(*) filter (document_match) as matches
from measured group by retrieved""",
    "eval_export": f"""with {SCORED}
select conv_id, turn, question, nullif(answer, '') as answer, correctness, retrieval, groundedness, document_match,
       case when quality = 1 then concat('One Page ', source, '.PDF', chr(10), '|not ', source, '.pdf')
            when quality = 0 then concat('not ', source, '.pdf|One Page ', source, '.PDF', chr(10))
            else '' end as retrieved_files,
       array_to_string(retrieved_contents, '|') as retrieved_contents
from measured""",
    "judge_prompt_build": f"""with {ANSWERS}
select conv_id, turn,
       concat('Question: ', question, chr(10), chr(10), '    Reference answer: ', true_answer, chr(10), chr(10),
              '    Generated answer: ', answer, chr(10), '    ') as correctness_prompt,
       concat('Question: ', question, chr(10), chr(10), '    Retrieved context: ', {_LISTED}, chr(10), chr(10),
              '    How likely is it that the retrieved context contains the necessary information to answer the question?',
              chr(10), '    Reply with a score from 1 (not at all) to 10 (completely covered). Only provide the score.',
              chr(10), '    ') as retrieval_prompt,
       concat(chr(10), '    Context/retrieved document: ', {_LISTED}, chr(10), chr(10), '    Generated answer: ', answer,
              chr(10), chr(10),
              '    Score the groundedness of the generated answer in the context from 1 (not grounded) to 10 (fully grounded). ',
              chr(10), '    Reply with only the score.', chr(10), '    ') as groundedness_prompt
from answers""",
}

# --- whole runs ----------------------------------------------------------------------------
GENERATED = f"""{CHUNKS}, {VECTOR_RANKS}, {CONTEXTS}, sentences as (
  select question_id, question, unnest(s) as raw, unnest(range(len(s))) as place
  from (
    select c.question_id, q.question, regexp_split_to_array(array_to_string(c.texts, chr(10)), '[.!?\\n]+') as s
    from contexts c join questions q on q.question_id = c.question_id
  )
), hits as (
  select question_id, trim(raw) as text, place, len(list_intersect({_words("raw")}, {_words("question")})) as hits
  from sentences where trim(raw) <> ''
), generated as (
  select q.question_id, q.question, coalesce(h.text, 'I don''t know.') as answer, c.titles, c.texts, c.joined
  from questions q left join contexts c on c.question_id = q.question_id
  left join (select * from hits qualify row_number() over (partition by question_id order by hits desc, place) = 1) h
    on h.question_id = q.question_id
)"""

# The last messages of threads that end in a question, instead of the benchmark.
_BENCHMARK = "select item_id as question_id, text as question from benchmark"
_WAITING = """select thread_id as question_id, content as question, turn as last_turn
  from (select *, max(turn) over (partition by thread_id) as last_turn from messages) where turn = last_turn and type = 'human'"""

# Threads that wait, with what a model sees of them; the queries that a policy makes of them.
_CALLED = "select concat(call, ':', thread_id) as question_id, query as question from called"
POLICY = f"""{MESSAGES}, seen as (
  select thread_id, list(type order by turn) as kinds, list(content order by turn) as said, count(*) as n
  from messages where type in ('human', 'system') or (type = 'ai' and not calls) group by thread_id
), waiting as (
  select s.thread_id, m.turn as last_turn, m.content as asked, s.said[1] as opening, s.n,
         array_to_string(list_transform(range(1, len(kinds) + 1), lambda i: concat(kinds[i], ': ', said[i])), chr(10)) as history
  from (select *, max(turn) over (partition by thread_id) as last from messages) m join seen s on s.thread_id = m.thread_id
  where m.turn = m.last and m.type = 'human'
), called as (
  select thread_id, 0 as call, asked as query from waiting where n % 3 > 0
  union all
  select thread_id, 1 as call, opening as query from waiting where n % 3 = 2
), {CHUNKS.replace(_BENCHMARK, _CALLED)}, {VECTOR_RANKS}, {CONTEXTS}, combined as (
  select c.thread_id, count(*) as queries, string_agg(x.serialised, chr(10) || chr(10) order by c.call) as serialised,
         flatten(list(x.texts order by c.call)) as texts, flatten(list(x.titles order by c.call)) as titles
  from called c left join contexts x on x.question_id = concat(c.call, ':', c.thread_id) group by c.thread_id
), sentences as (
  select thread_id, question, unnest(s) as raw, unnest(range(len(s))) as place
  from (
    select c.thread_id, w.asked as question, regexp_split_to_array(array_to_string(c.texts, chr(10)), '[.!?\\n]+') as s
    from combined c join waiting w on w.thread_id = c.thread_id
  )
), hits as (
  select thread_id, trim(raw) as text, place, len(list_intersect({_words("raw")}, {_words("question")})) as hits
  from sentences where trim(raw) <> ''
), best as (select * from hits qualify row_number() over (partition by thread_id order by hits desc, place) = 1)
select w.thread_id, w.last_turn, w.asked as question, coalesce(c.queries, 0) as queries,
       case when w.n % 3 = 0 then concat('You asked: ', w.asked) else coalesce(b.text, 'I don''t know.') end as answer,
       coalesce(array_to_string(c.titles, '|'), '') as source_names,
       case when w.n % 3 = 0 then w.history
            else concat('system: {_INSTRUCTION}', chr(10), chr(10), c.serialised, chr(10), w.history) end as prompt
from waiting w left join combined c on c.thread_id = w.thread_id left join best b on b.thread_id = w.thread_id"""

RUNS = {
    "thread_rag_policy": f"with {POLICY}",
    "thread_rag": f"""with {MESSAGES}, {GENERATED.replace(_BENCHMARK, _WAITING)}, seen as (
  select thread_id, string_agg(concat(type, ': ', content), chr(10) order by turn) as history
  from messages where type in ('human', 'system') or (type = 'ai' and not calls) group by thread_id
)
select g.question_id as thread_id, q.last_turn, g.question, g.answer, array_to_string(g.titles, '|') as source_names,
       concat('system: {_INSTRUCTION}', chr(10), chr(10), c.serialised, chr(10), s.history) as prompt
from generated g join questions q on q.question_id = g.question_id left join contexts c on c.question_id = g.question_id
join seen s on s.thread_id = g.question_id""",
    "batch_rag": f"""with {GENERATED}
select question_id, answer, array_to_string(titles, '|') as source_names,
       concat('You are an assistant for question-answering tasks. Use the following pieces of retrieved context to answer ',
              'the question. If you don''t know the answer, just say that you don''t know. Use three sentences maximum and ',
              'keep the answer concise.', chr(10), 'Question: ', question, ' ', chr(10), 'Context: ', joined, ' ', chr(10),
              'Answer:') as prompt
from generated""",
    "multiturn_rag": f"""with {GENERATED}
select question_id as thread_id, cast(4 as bigint) as messages, answer, array_to_string(titles, '|') as source_names
from generated""",
    "eval_summary_run": f"""with {GENERATED}, run as (
  select g.question_id as row_id, g.question, g.answer, d.text as true_answer, d.source as file,
         concat(' ', d.source, chr(10)) as raw_file, d.lang as document_type,
         replace(g.titles[1], '.pdf', '') as first_name, g.texts as contents, true as retrieved, g.titles
  from generated g left join documents d on d.doc_id = g.question_id
), {_measures("run")}, results as (
  select *, 'offline' as model, case when row_id % 2 = 0 then 'Positive' else 'Negative' end as question_type
  from measured where row_id % 5 > 0
), means as (
  select question_type, document_type, {_MEANS} from results where document_type is not null group by all
), facets as (
  select question_type, document_type, model, {_ERROR}, round_even(avg(cast(document_match as integer)) * 100 * 100, 0) / 100 as share
  from results where document_type in ('en', 'de', 'es', 'fr') group by all
), models as (select model, {_ERROR} from results group by all)
select 'scores' as summary, cast(null as varchar) as model, question_type, document_type, measure, value
from (unpivot (select question_type, document_type, cast(correctness as double) as correctness, cast(retrieval as double) as retrieval,
                      cast(groundedness as double) as groundedness from means)
      on correctness, retrieval, groundedness into name measure value value)
union all select 'matches', model, question_type, document_type, 'percentage_match', share from facets
union all select 'correctness', model, question_type, document_type, 'mean_correctness', mean_correctness from facets
union all select 'correctness', model, question_type, document_type, 'standard_error', standard_error from facets
union all select 'correctness', model, question_type, document_type, 'n', n from facets
union all select 'correctness by model', model, null, null, 'mean_correctness', mean_correctness from models
union all select 'correctness by model', model, null, null, 'standard_error', standard_error from models
union all select 'correctness by model', model, null, null, 'n', n from models
union all select 'responses', null, null, null, 'total', count(*) from results
union all select 'responses', null, null, null, 'offline', count(*) from results
union all select 'responses', null, null, null, lower(t), count(*) filter (question_type = t)
from results, (select unnest(['Positive', 'Negative']) as t) group by t""",
    "eval_run": f"""with {GENERATED}, run as (
  select g.question_id as row_id, g.question, g.answer, d.text as true_answer, d.source as file,
         concat(' ', d.source, chr(10)) as raw_file, d.lang as document_type,
         replace(g.titles[1], '.pdf', '') as first_name, g.texts as contents, true as retrieved, g.titles
  from generated g left join documents d on d.doc_id = g.question_id
), {_measures("run")}
select row_id, question, true_answer, raw_file as file, document_type, answer, correctness, retrieval, groundedness,
       document_match, array_to_string(titles, '|') as retrieved_files
from measured""",
}


# --- files ---------------------------------------------------------------------------------
FILES = {
    "summary_export": SUMMARY["neg_scores_by_doctype"],
    "truth_set_read": """
select b.text as "Question", d.text as "True Answer", concat(' ', d.source, chr(10)) as "File", d.lang as "Document Type"
from benchmark b left join documents d on d.doc_id = b.item_id""",
}


def _fused(sql: str, k: int) -> str:
    """SQL over the vector search's chunks as SQL over those of both searches, fused, `k` to a question."""
    ranks = f"""{VECTOR_RANKS.replace("rank <= 5", f"rank <= {k}")}, {TEXT_RANKS}, fused as (
  select coalesce(v.question_id, t.question_id) as question_id, coalesce(v.chunk_id, t.chunk_id) as chunk_id,
         coalesce(cast(1 as double) / (60 + v.rank), 0) + coalesce(cast(1 as double) / (60 + t.rank), 0) as score
  from vector_ranks v full join text_ranks t on v.question_id = t.question_id and v.chunk_id = t.chunk_id
), fused_ranks as (
  select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from fused qualify rank <= {k}
)"""
    return sql.replace(VECTOR_RANKS, ranks).replace("from vector_ranks r join", "from fused_ranks r join")


RUNS |= {
    "batch_rag_default": _fused(RUNS["batch_rag"], 4),
    "eval_run_default": _fused(RUNS["eval_run"], 5),
}
CONVERSATIONS["format_sources_csv"] = CONVERSATIONS["format_sources"]


def all_oracles() -> dict[str, str]:
    return {**SUMMARY, **DOCUMENTS, **RETRIEVAL, **CONVERSATIONS, **SCORES, **RUNS, **FILES}
