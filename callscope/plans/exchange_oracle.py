"""DuckDB text of the exchange stand-in, for differential oracles of the parsers.

DuckDB builds the same logical exchanges from ``conversations`` with its own
JSON construction (``json_object``) and the oracles then parse them with
DuckDB's JSON functions, so Spark's VARIANT-based parsing is compared with
an independent parser over the whole table.
"""

from callscope.sources.exchanges import _KINDS

_MODEL = "CASE a.conv_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _u) in enumerate(_KINDS)) + " END"

EXCHANGES_CTE = f"""ex0 AS (
  SELECT a.conv_id, a.turn, a.text AS answer, p.role AS prev_role, coalesce(p.text, '') AS prev_text, s.sys_text,
         {_MODEL} AS model_name, a.conv_id % 6 = 1 AS anthropic, a.turn % 4 = 3 AS stream,
         a.conv_id % 23 = 9 AS failed, a.conv_id % 29 = 0 AND a.turn = 1 AS non_llm
  FROM conversations a
  LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS sys_text FROM conversations WHERE role = 'system'
             GROUP BY conv_id) s ON s.conv_id = a.conv_id
  WHERE a.role = 'assistant'),
ex1 AS (
  SELECT *, (conv_id % 13 = 4) AND NOT stream AND NOT failed AS limited,
         json_object('role', CASE WHEN prev_role = 'assistant' THEN 'assistant' ELSE 'user' END,
                     'content', prev_text) AS user_msg,
         CAST(10 + floor((length(prev_text) + coalesce(length(sys_text), 0)) / 4) AS BIGINT) AS n_in,
         CAST(1 + floor(length(answer) / 4) AS BIGINT) AS n_out,
         CASE WHEN conv_id % 5 = 0 THEN CAST(floor(CAST(10 + floor((length(prev_text)
              + coalesce(length(sys_text), 0)) / 4) AS BIGINT) / 2) AS BIGINT) ELSE 0 END AS cached,
         CASE WHEN conv_id % 5 = 1 THEN CAST(floor(CAST(10 + floor((length(prev_text)
              + coalesce(length(sys_text), 0)) / 4) AS BIGINT) / 3) AS BIGINT) ELSE 0 END AS cache_write
  FROM ex0),
ex2 AS (
  SELECT *, CASE WHEN sys_text IS NOT NULL
                 THEN json_array(json_object('role', 'system', 'content', sys_text), user_msg)
                 ELSE json_array(user_msg) END AS oai_msgs
  FROM ex1),
ex AS (
  SELECT lpad(CAST(conv_id AS VARCHAR), 6, '0') || '-' || lpad(CAST(turn AS VARCHAR), 3, '0') AS exchange_id,
    conv_id, turn, stream, failed, non_llm, anthropic, limited,
    CASE WHEN non_llm THEN '' ELSE (CASE
      WHEN anthropic THEN
        CASE WHEN conv_id % 17 = 5 THEN json_object('system', sys_text, 'messages', json_array(user_msg),
                                                    'max_tokens', 1024, 'stream', stream)
             WHEN conv_id % 19 = 7 THEN json_object('model', 42, 'system', sys_text, 'messages', json_array(user_msg),
                                                    'max_tokens', 1024, 'stream', stream)
             ELSE json_object('model', model_name, 'system', sys_text, 'messages', json_array(user_msg),
                              'max_tokens', 1024, 'stream', stream) END
      ELSE
        CASE WHEN conv_id % 17 = 5 THEN json_object('messages', oai_msgs, 'stream', stream)
             WHEN conv_id % 19 = 7 THEN json_object('model', 42, 'messages', oai_msgs, 'stream', stream)
             ELSE json_object('model', model_name, 'messages', oai_msgs, 'stream', stream) END
    END)::VARCHAR END AS request_body,
    CASE WHEN non_llm THEN '/v1/models' WHEN anthropic THEN '/v1/messages'
         WHEN conv_id % 6 = 4 THEN '/v1/chat/completions?api-version=2024-06-01'
         ELSE '/v1/chat/completions' END AS path,
    CASE WHEN conv_id % 3 = 0 THEN '00-' || md5(CAST(conv_id AS VARCHAR)) || '-'
         || substr(md5(CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)), 1, 16) || '-01' END AS h_traceparent,
    CASE WHEN conv_id % 3 = 1 THEN 'trace-' || CAST(conv_id AS VARCHAR) END AS h_trace_id,
    CASE WHEN conv_id % 3 = 1 AND turn > 1 THEN 'span-' || CAST(turn - 2 AS VARCHAR) END AS h_parent_span,
    CASE WHEN conv_id % 3 = 2 THEN md5(CAST(conv_id AS VARCHAR)) END AS h_b3_trace,
    CASE turn % 4 WHEN 0 THEN 'planner' WHEN 1 THEN 'researcher' WHEN 2 THEN 'writer' END AS h_agent,
    CASE WHEN conv_id % 4 <> 0 THEN 'wf-' || CAST(conv_id % 10 AS VARCHAR) END AS h_workflow,
    CASE WHEN conv_id % 10 = 1 THEN 'exp-a' END AS h_tag,
    'turn-' || CAST(turn AS VARCHAR) AS h_span,
    CASE WHEN failed THEN NULL WHEN stream THEN 'text/event-stream; charset=utf-8' ELSE 'application/json' END
      AS h_content_type,
    CASE WHEN failed OR (stream AND NOT non_llm) THEN NULL
         WHEN non_llm THEN '{{"data":[]}}'
         WHEN limited THEN '{{"error":{{"message":"Rate limit exceeded"}}}}'
         WHEN anthropic THEN json_object('content', json_array(json_object('type', 'text', 'text', answer)),
              'usage', json_object('input_tokens', n_in, 'output_tokens', n_out, 'cache_read_input_tokens', cached,
                                   'cache_creation_input_tokens', cache_write))::VARCHAR
         ELSE json_object('choices', json_array(json_object('index', 0, 'message',
              json_object('role', 'assistant', 'content', answer))),
              'usage', json_object('prompt_tokens', n_in, 'completion_tokens', n_out,
                                   'prompt_tokens_details', json_object('cached_tokens', cached)))::VARCHAR
    END AS response_body
  FROM ex2)"""


def jint(doc: str, path: str) -> str:
    """Integer at path only when it is a JSON integer (DuckDB JSON types)."""
    return (f"CASE WHEN try(json_type({doc}, '{path}')) IN ('UBIGINT', 'BIGINT') "
            f"THEN try(CAST(json_extract({doc}, '{path}') AS BIGINT)) END")


def model_sql(doc: str = "request_body") -> str:
    return (f"coalesce(CASE WHEN try(json_type({doc}, '$.model')) = 'VARCHAR' "
            f"THEN try(json_extract_string({doc}, '$.model')) END, 'unknown')")


def stream_sql(doc: str = "request_body") -> str:
    return (f"coalesce(CASE WHEN try(json_type({doc}, '$.stream')) = 'BOOLEAN' "
            f"THEN try(CAST(json_extract({doc}, '$.stream') AS BOOLEAN)) END, false)")


def with_ex(sql: str) -> str:
    return f"WITH {EXCHANGES_CTE} {sql}"


def _data(expr: str) -> str:
    return f"'data: ' || ({expr})::VARCHAR"


SSE_CTE = EXCHANGES_CTE + f""",
sse0 AS (
  SELECT exchange_id, conv_id, anthropic, conv_id % 7 = 3 AS tools, n_in, n_out, cached, cache_write,
         regexp_extract_all(answer, '(?s).{{1,40}}') AS pieces
  FROM ex2 JOIN (SELECT lpad(CAST(conv_id AS VARCHAR), 6, '0') || '-' || lpad(CAST(turn AS VARCHAR), 3, '0') AS exchange_id,
                        stream AND NOT failed AND NOT non_llm AS use_stream FROM ex2) u
    ON u.exchange_id = lpad(CAST(ex2.conv_id AS VARCHAR), 6, '0') || '-' || lpad(CAST(ex2.turn AS VARCHAR), 3, '0')
  WHERE use_stream),
sse1 AS (
  SELECT exchange_id, conv_id, anthropic, tools, n_in, n_out, cached, cache_write,
    CASE WHEN anthropic THEN
      list_concat(
        ['event: message_start' || chr(10) || {_data("json_object('type', 'message_start', 'message', json_object('usage', json_object('input_tokens', n_in, 'output_tokens', 1, 'cache_read_input_tokens', cached, 'cache_creation_input_tokens', cache_write)))")}],
        CASE WHEN tools THEN [
          {_data("json_object('type', 'content_block_start', 'index', 0, 'content_block', json_object('type', 'tool_use', 'name', 'find_tide'))")},
          {_data("json_object('type', 'content_block_delta', 'delta', json_object('type', 'input_json_delta', 'partial_json', '{\"harbour\":'))")},
          {_data("json_object('type', 'content_block_delta', 'delta', json_object('type', 'input_json_delta', 'partial_json', ' \"C' || CAST(conv_id AS VARCHAR) || '\"}'))")}]
        ELSE list_transform(pieces, lambda p: {_data("json_object('type', 'content_block_delta', 'delta', json_object('type', 'text_delta', 'text', p))")}) END,
        [{_data("json_object('type', 'message_delta', 'usage', json_object('output_tokens', n_out))")},
         'event: message_stop' || chr(10) || {_data("json_object('type', 'message_stop')")}])
    ELSE
      list_concat(
        CASE WHEN tools THEN [
          {_data("json_object('choices', json_array(json_object('index', 0, 'delta', json_object('tool_calls', json_array(json_object('index', 0, 'function', json_object('name', 'find_tide', 'arguments', '')))))))")},
          {_data("json_object('choices', json_array(json_object('index', 0, 'delta', json_object('tool_calls', json_array(json_object('index', 0, 'function', json_object('arguments', '{\"harbour\":')))))))")},
          {_data("json_object('choices', json_array(json_object('index', 0, 'delta', json_object('tool_calls', json_array(json_object('index', 0, 'function', json_object('arguments', ' \"C' || CAST(conv_id AS VARCHAR) || '\"}')))))))")}]
        ELSE list_transform(pieces, lambda p: {_data("json_object('choices', json_array(json_object('index', 0, 'delta', json_object('content', p))))")}) END,
        [{_data("json_object('choices', json_array(), 'usage', json_object('prompt_tokens', n_in, 'completion_tokens', n_out, 'prompt_tokens_details', json_object('cached_tokens', cached)))")},
         'data: [DONE]'])
    END AS events
  FROM sse0),
sse AS (
  SELECT exchange_id, conv_id,
    list_transform(list_filter(string_split(
        CASE WHEN conv_id % 2 = 0 THEN ': keep-alive' || chr(10) || chr(10) ELSE '' END
        || array_to_string(events, chr(10) || chr(10)) || chr(10) || chr(10), chr(10)),
      lambda l: starts_with(l, 'data: ') AND trim(substr(l, 7)) <> '[DONE]'),
      lambda l: substr(l, 7)) AS datas
  FROM sse1)"""


def with_sse(sql: str) -> str:
    return f"WITH {SSE_CTE} {sql}"
