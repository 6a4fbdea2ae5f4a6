"""DuckDB SQL for the registered queries, over the driver's tables.

`PARTS` are named subqueries: the mapping of FIXTURES.md, then the marts, each stated the
plain way (joins first, correlated where the definition is correlated). `with_parts` puts
the ones a query needs in front of it.
"""

from __future__ import annotations

import re

from casestats import fixed_values as fixed
from casestats.sources import schemas

AS_OF = "TIMESTAMP '2001-08-01 12:00:00'"
PERIOD = "data BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'"


def _sunday(d: str) -> str:
    return f"(CAST({d} AS DATE) - CAST(dayofweek({d}) AS INTEGER))"


def _label(a: str, b: str) -> str:
    return (
        f"CASE WHEN month({a}) = month({b}) THEN strftime({a}, '%d') "
        f"ELSE strftime({a}, '%d/%b') END || '-' || strftime({b}, '%d/%b')"
    )


def _filings(where: str) -> str:
    week = _sunday("p.dta_geracao")
    return f"""
    SELECT orgao, unidade, CAST(year(inicio) AS INTEGER) AS ano,
           CAST(floor((dayofyear(inicio) + 6) / 7) AS INTEGER) AS semana,
           inicio, CAST(inicio + 6 AS DATE) AS fim,
           {_label("inicio", "(inicio + 6)")} AS intervalo, total
    FROM (SELECT u.orgao, u.unidade, {week} AS inicio, count(*) AS total
          FROM processo p JOIN nomes u ON u.id_unidade = p.id_unidade_geradora
          WHERE p.dta_geracao < {_sunday(AS_OF)} {where}
          GROUP BY ALL)"""


PARTS = {
    # The mapping
    "orgao": """
    SELECT CAST(r_regionkey AS BIGINT) AS id_orgao, r_name AS sigla,
           CASE WHEN r_regionkey = 4 THEN 'N' ELSE 'S' END AS sin_ativo
    FROM region""",
    "unidade": """
    SELECT CAST(n_nationkey AS BIGINT) AS id_unidade,
           CAST(n_regionkey AS BIGINT) AS id_orgao, n_name AS sigla
    FROM nation""",
    "usuario": """
    SELECT c_custkey AS id_usuario, CAST(n_regionkey AS BIGINT) AS id_orgao,
           c_name AS nome, CASE WHEN c_acctbal > 0 THEN 'S' ELSE 'N' END AS sin_ativo
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "protocolo": """
    SELECT o_orderkey AS id_protocolo, CAST(o_orderkey AS VARCHAR) AS protocolo_formatado,
           o_orderstatus AS sta_protocolo, o_orderdate AS dta_geracao,
           CAST(c_nationkey AS BIGINT) AS id_unidade_geradora,
           o_custkey AS id_usuario_gerador,
           CAST(o_orderkey % 4 AS INTEGER) AS sta_nivel_acesso_global,
           o_orderpriority AS descricao
    FROM orders JOIN customer ON o_custkey = c_custkey""",
    "procedimento": """
    SELECT o_orderkey AS id_procedimento,
           CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_tipo_procedimento
    FROM orders""",
    "tipo_procedimento": """
    SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_tipo_procedimento,
           o_orderpriority AS nome
    FROM orders""",
    "atividade": f"""
    SELECT id_atividade, id_protocolo, id_unidade, id_tarefa, dth_abertura,
           CASE WHEN l_linestatus <> 'O'
                THEN dth_abertura + to_days(CAST(floor(l_quantity) AS INTEGER))
           END AS dth_conclusao,
           id_usuario_atribuicao
    FROM (SELECT l_orderkey * 1000 + row_number() OVER (
                     PARTITION BY l_orderkey
                     ORDER BY l_shipdate, l_linenumber, l_suppkey, l_partkey,
                              l_extendedprice) AS id_atividade,
                 l_orderkey AS id_protocolo,
                 CAST(s_nationkey AS BIGINT) AS id_unidade,
                 CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 28 WHEN 3 THEN 29
                      WHEN 4 THEN 41 WHEN 5 THEN 32 WHEN 6 THEN 28 WHEN 7 THEN 99
                 END AS id_tarefa,
                 least(o_orderdate
                       + to_days(CAST((l_partkey + 7 * l_linenumber) % 30 AS INTEGER)),
                       {AS_OF}) AS dth_abertura,
                 CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END
                     AS id_usuario_atribuicao,
                 l_linestatus, l_quantity
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN supplier ON l_suppkey = s_suppkey)""",
    "anexo": "SELECT doc_id % 25 AS id_unidade, n_chars AS tamanho FROM documents",
    "documento": """
    SELECT doc_id AS id_documento, doc_id * 7 % 25 AS id_unidade_responsavel,
           CASE WHEN doc_id % 2 = 0 THEN 'I' ELSE 'X' END AS sta_documento
    FROM documents""",
    "documento_conteudo": "SELECT doc_id AS id_documento, text AS conteudo FROM documents",
    "auth": f"""
    SELECT 'tok_' || c_custkey AS token, c_custkey AS id_user,
           {AS_OF} - to_hours(CAST(c_custkey % 72 AS INTEGER)) AS created_at
    FROM customer""",
    "permissao": """
    SELECT c_custkey AS id_user,
           CASE WHEN c_custkey % 50 = 0 THEN 99 ELSE c_custkey % 5 END AS id_orgao
    FROM customer""",
    "acesso_orgao": """
    SELECT r_regionkey AS id, r_name AS sigla FROM region
    UNION ALL SELECT 99, '*'""",
    "papel": """
    SELECT o.sigla AS orgao, CAST(p.dta_geracao AS DATE) AS data, count(*) AS papel
    FROM protocolo p JOIN unidade u ON u.id_unidade = p.id_unidade_geradora
    JOIN orgao o ON o.id_orgao = u.id_orgao
    WHERE p.sta_protocolo <> 'P' GROUP BY ALL""",
    # Shared by several marts
    "nomes": """
    SELECT u.id_unidade, o.sigla AS orgao, u.sigla AS unidade
    FROM unidade u JOIN orgao o ON o.id_orgao = u.id_orgao""",
    "processo": """
    SELECT p.*, t.nome AS tipo_processo
    FROM protocolo p JOIN procedimento h ON h.id_procedimento = p.id_protocolo
    JOIN tipo_procedimento t ON t.id_tipo_procedimento = h.id_tipo_procedimento
    WHERE p.sta_protocolo = 'P'""",
    # Marts
    "active_orgs": "SELECT sigla FROM orgao WHERE sin_ativo = 'S'",
    "processes_by_org_unit": """
    SELECT u.orgao, u.unidade, count(*) AS total
    FROM protocolo p JOIN nomes u ON u.id_unidade = p.id_unidade_geradora
    WHERE p.sta_protocolo = 'P' GROUP BY ALL""",
    "active_users_by_org": """
    SELECT o.sigla AS orgao, count(*) AS total
    FROM usuario s JOIN orgao o ON o.id_orgao = s.id_orgao
    WHERE s.sin_ativo = 'S' GROUP BY ALL""",
    "distinct_process_types": """
    SELECT count(DISTINCT t.nome) AS total
    FROM protocolo p JOIN procedimento h ON h.id_procedimento = p.id_protocolo
    JOIN tipo_procedimento t ON t.id_tipo_procedimento = h.id_tipo_procedimento""",
    "process_types_by_org_unit": """
    SELECT u.orgao, u.unidade, p.tipo_processo, count(*) AS total
    FROM processo p JOIN nomes u ON u.id_unidade = p.id_unidade_geradora GROUP BY ALL""",
    "weekly_filings": _filings(f"AND p.dta_geracao >= {_sunday(AS_OF)} - 70"),
    "weekly_history": _filings(""),
    "monthly_filings": """
    SELECT u.orgao, CAST(year(p.dta_geracao) AS INTEGER) AS ano,
           CAST(month(p.dta_geracao) AS INTEGER) AS mes,
           month(p.dta_geracao) || '/' || year(p.dta_geracao) AS periodo,
           count(*) AS total
    FROM processo p JOIN nomes u ON u.id_unidade = p.id_unidade_geradora GROUP BY ALL""",
    "stock_movements": """
    SELECT u.orgao, u.unidade, p.tipo_processo,
           CASE WHEN a.id_tarefa IN (1, 29, 32) THEN 'Entrada' ELSE 'Saída' END
               AS atividade,
           CAST(a.dth_abertura AS DATE) AS data, p.id_protocolo AS protocolo,
           count(*) AS qtde
    FROM atividade a JOIN nomes u ON u.id_unidade = a.id_unidade
    JOIN processo p ON p.id_protocolo = a.id_protocolo
    WHERE a.id_tarefa IN (1, 29, 32, 28, 41)
      AND p.id_protocolo IN (SELECT id_protocolo FROM atividade
                             WHERE dth_conclusao IS NULL)
    GROUP BY ALL""",
    "stock_units": "SELECT DISTINCT orgao, unidade FROM stock_movements",
    "open_process_control": f"""
    SELECT u.orgao, u.unidade, p.protocolo_formatado AS num_processo,
           CAST(year(p.dta_geracao) AS INTEGER) AS ano,
           CAST(month(p.dta_geracao) AS INTEGER) AS mes,
           CAST(day(p.dta_geracao) AS INTEGER) AS dia,
           s.nome AS usuario, p.tipo_processo,
           CASE p.sta_nivel_acesso_global WHEN 0 THEN 'Público' WHEN 1 THEN 'Restrito'
                WHEN 2 THEN 'Sigiloso' END AS nivel_acesso,
           p.descricao, c.sigla AS unidade_atual, o.sigla AS orgao_atual,
           date_diff('day', a.dth_abertura, {AS_OF}) AS dias_unidade,
           date_diff('day', p.dta_geracao, {AS_OF}) AS tempo_vida,
           r.nome AS atribuido,
           day(p.dta_geracao) || '/' || month(p.dta_geracao) || '/'
               || year(p.dta_geracao) AS data,
           CAST(p.dta_geracao AS DATE) AS data_filtro
    FROM processo p JOIN nomes u ON u.id_unidade = p.id_unidade_geradora
    JOIN usuario s ON s.id_usuario = p.id_usuario_gerador
    JOIN atividade a ON a.id_protocolo = p.id_protocolo
    LEFT JOIN unidade c ON c.id_unidade = a.id_unidade
    LEFT JOIN orgao o ON o.id_orgao = c.id_orgao
    LEFT JOIN usuario r ON r.id_usuario = a.id_usuario_atribuicao
    WHERE a.dth_conclusao IS NULL""",
    "open_process_summary": """
    SELECT num_processo, data, tipo_processo, nivel_acesso, unidade_atual, dias_unidade,
           atribuido, data_filtro, orgao_atual
    FROM open_process_control""",
    "current_unit_options": """
    SELECT DISTINCT orgao_atual, unidade_atual FROM open_process_control""",
    "process_lifetime": f"""
    SELECT u.orgao, u.unidade, p.tipo_processo,
           date_diff('day', p.dta_geracao, coalesce(a.dth_conclusao, {AS_OF}))
               AS tempo_vida
    FROM processo p JOIN nomes u ON u.id_unidade = p.id_unidade_geradora
    JOIN atividade a ON a.id_protocolo = p.id_protocolo
    JOIN (SELECT id_protocolo, max(id_atividade) AS ultima FROM atividade GROUP BY ALL) m
      ON m.ultima = a.id_atividade""",
    "lifetime_median_by_type": """
    SELECT tipo_processo, quantile_cont(tempo_vida, 0.5) AS mediana
    FROM process_lifetime GROUP BY ALL""",
    "assignee_days": """
    SELECT orgao_atual AS orgao, unidade_atual, tipo_processo, atribuido, dias_unidade
    FROM open_process_control""",
    "days_in_unit_median_by_type": """
    SELECT tipo_processo, quantile_cont(dias_unidade, 0.5) AS mediana
    FROM assignee_days GROUP BY ALL""",
    "lifetime_first_quartile": """
    SELECT quantile_cont(tempo_vida, 0.25) AS q1 FROM process_lifetime""",
    "external_pages": """
    SELECT u.orgao, u.unidade,
           CAST(sum(a.tamanho) AS DOUBLE) / 1024 / 335 AS folhas
    FROM anexo a JOIN nomes u ON u.id_unidade = a.id_unidade GROUP BY ALL""",
    "internal_pages": """
    SELECT u.orgao, u.unidade,
           CAST(sum(strlen(c.conteudo)) AS DOUBLE) / 1024 / CAST(37.5 AS DOUBLE) AS folhas
    FROM documento d JOIN documento_conteudo c ON c.id_documento = d.id_documento
    JOIN nomes u ON u.id_unidade = d.id_unidade_responsavel
    WHERE d.sta_documento = 'I' GROUP BY ALL""",
    "pages_saved": """
    SELECT e.orgao, e.unidade, e.folhas + i.folhas AS soma
    FROM external_pages e
    JOIN internal_pages i ON i.orgao = e.orgao AND i.unidade = e.unidade""",
    # Roll-ups
    "lifetime_counts": """
    SELECT orgao, unidade, tipo_processo, tempo_vida, count(*) AS processos
    FROM process_lifetime GROUP BY ALL""",
    "days_in_unit_counts": """
    SELECT orgao, unidade_atual, tipo_processo, atribuido, dias_unidade,
           count(*) AS atividades
    FROM assignee_days GROUP BY ALL""",
    "open_activity_rollup": """
    SELECT 0 AS nivel, orgao, unidade_atual, tipo_processo, atribuido, dias_unidade,
           count(*) AS atividades
    FROM assignee_days GROUP BY ALL
    UNION ALL
    SELECT 1, orgao, unidade_atual, tipo_processo, NULL, dias_unidade, count(*)
    FROM assignee_days GROUP BY ALL""",
    "days_in_unit_totals": """
    SELECT orgao, unidade_atual, tipo_processo, dias_unidade, count(*) AS atividades
    FROM assignee_days GROUP BY ALL""",
    "stock_daily": """
    SELECT orgao, unidade, tipo_processo, atividade, data, CAST(sum(qtde) AS BIGINT) AS qtde
    FROM stock_movements GROUP BY ALL""",
}


def with_parts(query: str) -> str:
    needed, queue = set(), [query]
    while queue:
        text = queue.pop()
        for name in PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                queue.append(PARTS[name])
    parts = [f"{name} AS ({PARTS[name]})" for name in PARTS if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query


# Selections, as conditions

AFRICA = "orgao = 'AFRICA'"
UNIT = "unidade = 'NATION_5'"
TYPE = "tipo_processo = '2-HIGH'"
SUBUNITS = "regexp_matches(unidade, 'NATION_1')"
SCOPES = {
    "all": "true",
    "org": AFRICA,
    "unit": UNIT,
    "org_unit": f"{AFRICA} AND {UNIT}",
}
STOCK_SCOPES = {
    "all": "true",
    "org": AFRICA,
    "unit": UNIT,
    "type": TYPE,
    "org_unit": f"{AFRICA} AND {UNIT}",
    "org_type": f"{AFRICA} AND {TYPE}",
    "unit_type": f"{UNIT} AND {TYPE}",
    "org_unit_type": f"{AFRICA} AND {UNIT} AND {TYPE}",
    "subunits": SUBUNITS,
    "org_subunits": f"orgao = 'AMERICA' AND {SUBUNITS}",
    "subunits_type": f"{SUBUNITS} AND {TYPE}",
    "org_subunits_type": f"orgao = 'AMERICA' AND {SUBUNITS} AND {TYPE}",
}


def current(condition: str) -> str:
    """The same condition on where a process is now."""
    return re.sub(r"\b(orgao|unidade)\b", r"\1_atual", condition)


def current_unit(condition: str) -> str:
    return re.sub(r"\bunidade\b", "unidade_atual", condition)


# Queries


def _total(mart: str, value: str, condition: str, name: str = "total") -> str:
    return (
        f"SELECT CAST(coalesce(sum({value}), 0) AS BIGINT) AS {name} "
        f"FROM {mart} WHERE {condition}"
    )


def _top_types(condition: str) -> str:
    return f"""
    SELECT tipo_processo, total,
           CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS participacao
    FROM (SELECT tipo_processo, CAST(sum(total) AS BIGINT) AS total
          FROM process_types_by_org_unit WHERE {condition} GROUP BY ALL)"""


def _number(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def _deviation(scoped: str, overall: str, columns: str) -> str:
    return f"""
    SELECT {columns}, s.mediana,
           CASE WHEN s.mediana - g.mediana > 0
                THEN 'Atrasado  ' || {_number("abs(s.mediana - g.mediana)")} || '  dias'
                WHEN s.mediana < (SELECT quantile_cont(tempo_vida, 0.25)
                                  FROM process_lifetime) THEN 'Adiantado'
                ELSE 'Dentro do esperado' END AS desvio
    FROM ({scoped}) s JOIN {overall} g ON g.tipo_processo = s.tipo_processo"""


def _lifetime_by_type(key: str, condition: str) -> str:
    if key == "all":
        return "SELECT tipo_processo, mediana FROM lifetime_median_by_type"
    scoped = f"""SELECT tipo_processo, quantile_cont(tempo_vida, 0.5) AS mediana
                 FROM process_lifetime WHERE {condition} GROUP BY ALL"""
    return _deviation(scoped, "lifetime_median_by_type", "s.tipo_processo")


def _assignee_time(key: str, condition: str) -> str:
    scoped = f"""SELECT atribuido, tipo_processo,
                        quantile_cont(dias_unidade, 0.5) AS mediana
                 FROM assignee_days
                 WHERE atribuido IS NOT NULL AND {current_unit(condition)} GROUP BY ALL"""
    if key == "all":
        return scoped
    return _deviation(
        f"SELECT * FROM ({scoped}) WHERE atribuido <> ' '",
        "days_in_unit_median_by_type",
        "s.atribuido, s.tipo_processo",
    )


def _options(column: str, mart: str, condition: str, entry: str) -> str:
    return f"""
    SELECT '{entry}' AS opcao UNION ALL
    SELECT {column} FROM (SELECT DISTINCT * FROM {mart})
    WHERE {column} <> '*' AND {condition}"""


def _flow(condition: str) -> str:
    return f"""
    SELECT data, atividade, CAST(sum(qtde) AS BIGINT) AS qtde
    FROM stock_movements WHERE {PERIOD} AND {condition} GROUP BY ALL"""


_SIGNED = "CASE WHEN atividade = 'Entrada' THEN qtde ELSE -qtde END"


def _balance(condition: str, by: str = "") -> str:
    """Opening balance and days in the period apart, the balance as a prefix sum."""
    keys = f"{by}, " if by else ""
    same = " AND ".join(f"o.{k.strip()} = d.{k.strip()}" for k in by.split(",")) if by else "true"
    partition = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    d_by = "".join(f"d.{k.strip()}, " for k in by.split(",")) if by else ""
    return f"""
    SELECT {d_by}data, CAST(liquido + CASE WHEN n = 1 THEN abertura ELSE 0 END AS BIGINT)
               AS estoque_diario,
           CAST(acumulado + abertura AS BIGINT) AS estoque
    FROM (SELECT d.*, coalesce(o.saldo, 0) AS abertura
          FROM (SELECT {keys}data, liquido,
                       row_number() OVER ({partition} ORDER BY data) AS n,
                       sum(liquido) OVER ({partition} ORDER BY data) AS acumulado
                FROM (SELECT {keys}data, sum({_SIGNED}) AS liquido FROM stock_movements
                      WHERE {PERIOD} AND {condition} GROUP BY ALL)) d
          LEFT JOIN (SELECT {keys}sum({_SIGNED}) AS saldo FROM stock_movements
                     WHERE data < DATE '2000-01-01' AND {condition} {group}) o
            ON {same}) d"""


def _chart(condition: str) -> str:
    return f"""
    SELECT b.data, e.qtde AS entrada, s.qtde AS saida, b.estoque
    FROM ({_balance(condition)}) b
    LEFT JOIN ({_flow(condition)}) e ON e.data = b.data AND e.atividade = 'Entrada'
    LEFT JOIN ({_flow(condition)}) s ON s.data = b.data AND s.atividade = 'Saída'"""


TABLE = ", ".join(fixed.TABLE_HEADERS)
EXPORT = fixed.EXPORT_HEADERS


def _export(condition: str, as_text: bool = False) -> str:
    columns = ", ".join(
        f'CAST({c} AS VARCHAR) AS "{h}"' if as_text else f'{c} AS "{h}"'
        for c, h in EXPORT.items()
    )
    return f"SELECT {columns} FROM open_process_control WHERE {current(condition)}"


def _boxes(condition: str) -> str:
    return f"""
    SELECT b.tipo_processo, b.processos, b.minimo, b.q1, b.mediana, b.q3, b.maximo,
           min(CASE WHEN dentro THEN tempo_vida END) AS haste_inferior,
           max(CASE WHEN dentro THEN tempo_vida END) AS haste_superior,
           count(*) FILTER (WHERE NOT dentro) AS discrepantes
    FROM (SELECT l.tempo_vida, q.*,
                 l.tempo_vida BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
                     AS dentro
          FROM process_lifetime l
          JOIN (SELECT tipo_processo, count(*) AS processos, min(tempo_vida) AS minimo,
                       quantile_cont(tempo_vida, 0.25) AS q1,
                       quantile_cont(tempo_vida, 0.5) AS mediana,
                       quantile_cont(tempo_vida, 0.75) AS q3, max(tempo_vida) AS maximo
                FROM process_lifetime WHERE {condition} GROUP BY ALL) q
            ON q.tipo_processo = l.tipo_processo
          WHERE {condition}) b
    GROUP BY ALL"""


def _authorized(token: str) -> str:
    granted = f"""
        SELECT g.sigla FROM auth a JOIN permissao p ON p.id_user = a.id_user
        JOIN acesso_orgao g ON g.id = p.id_orgao
        WHERE a.token = '{token}'
          AND a.created_at > CAST(CAST({AS_OF} AS DATE) - 1 AS TIMESTAMP)"""
    unlimited = f"'*' IN ({granted})"
    return f"""
    SELECT 'Todos' AS orgao WHERE {unlimited}
    UNION ALL SELECT sigla FROM active_orgs WHERE {unlimited}
    UNION ALL SELECT sigla FROM ({granted}) WHERE NOT {unlimited}"""


def _restricted(token: str) -> str:
    return f"""
    SELECT orgao, unidade, tipo_processo, total FROM process_types_by_org_unit
    WHERE orgao IN ({_authorized(token)}) OR 'Todos' IN ({_authorized(token)})"""


def _ranking(electronic: str, start: str, end: str, minimum: int) -> str:
    return f"""
    SELECT orgao, eletronico, papel, proporcao,
           rank() OVER (ORDER BY proporcao DESC NULLS FIRST) AS posicao
    FROM (SELECT orgao, eletronico, papel,
                 CASE WHEN papel > 0 THEN CAST(eletronico AS DOUBLE) / papel END
                     AS proporcao
          FROM (SELECT coalesce(e.orgao, p.orgao) AS orgao,
                       CAST(coalesce(e.n, 0) AS BIGINT) AS eletronico,
                       CAST(coalesce(p.n, 0) AS BIGINT) AS papel
                FROM ({electronic}) e
                FULL JOIN (SELECT orgao, sum(papel) AS n FROM papel
                           WHERE data >= {start} AND data < {end} GROUP BY ALL) p
                  ON p.orgao = e.orgao)
          WHERE eletronico + papel >= {minimum})"""


def _as_text(column: str, kind: str) -> str:
    """A value in the one form that is hashed."""
    return {
        "STRING": column,
        "TIMESTAMP": f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')",
        "DATE": f"strftime({column}, '%Y-%m-%d')",
        "DOUBLE": f"CAST(CAST(floor({column} * 1000) AS BIGINT) AS VARCHAR)",
    }.get(kind, f"CAST({column} AS VARCHAR)")


def _digest(tables: dict[str, str]) -> str:
    """Rows, values, least, greatest and sum of hashes by column, and of whole rows (`*`)."""

    def entry(name, filled, least, greatest, text):
        number = f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
        return (
            f"{{'coluna': '{name}', 'linhas': count(*), 'preenchidos': {filled}, "
            f"'minimo': {least}, 'maximo': {greatest}, "
            f"'soma': CAST(coalesce(sum({number}), 0) AS VARCHAR)}}"
        )

    parts = []
    for table, ddl in tables.items():
        kinds = dict(sorted(c.split() for c in ddl.split(", ")))
        texts = ", ".join(f"{_as_text(c, k)} AS {c}" for c, k in kinds.items())
        whole = ", ".join(f"coalesce('v' || {c}, 'n')" for c in kinds)
        none = "CAST(NULL AS VARCHAR)"
        entries = [
            entry(c, f"count({c})", f"left(min({c}), 64)", f"left(max({c}), 64)", c) for c in kinds
        ]
        entries.append(entry("*", "count(*)", none, none, f"concat_ws(chr(31), {whole})"))
        parts.append(
            f"SELECT '{table}' AS nome, unnest(entries, recursive := true) FROM "
            f"(SELECT [{', '.join(entries)}] AS entries FROM (SELECT {texts} FROM {table}))"
        )
    return " UNION ALL ".join(parts)


def _numbered(query: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS posicao FROM ({query})"


def _titled(query: str, titles: dict[str, str]) -> str:
    columns = ", ".join(f'{c} AS "{t}"' for c, t in titles.items())
    return f"SELECT {columns} FROM ({query})"


def _dotted(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', '.')"


def _dates() -> str:
    w = _sunday("d")
    return f"""
    SELECT d AS dia, {w} AS inicio,
           CAST(floor((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) / 7) + 1
                AS INTEGER) AS semana,
           CAST(strftime({w}, '%U') AS INTEGER) AS domingo,
           {_label(w, f"({w} + 6)")} AS intervalo,
           CAST(date_trunc('month', d) AS DATE) AS mes,
           CAST(date_trunc('month', d) AS DATE) - 1 AS fim_mes_anterior,
           day(d) || '/' || month(d) || '/' || year(d) AS curta,
           month(d) || '/' || year(d) AS periodo
    FROM (SELECT DISTINCT CAST(dta_geracao AS DATE) AS d FROM protocolo)"""


MARTS = list(PARTS)[list(PARTS).index("active_orgs") :]


def build() -> dict[str, str]:
    q: dict[str, str] = {name: f"SELECT * FROM {name}" for name in MARTS}

    q["load_tables"] = q["land_tables"] = _digest(schemas.CASE_TABLES)
    q["load_access_tables"] = q["land_access_tables"] = _digest(schemas.ACCESS_TABLES)
    q["write_marts"] = _digest({name: schemas.MARTS[name] for name in MARTS})
    q["open_process_sets"] = """
        SELECT orgao_atual, unidade_atual, tipo_processo,
               count(DISTINCT num_processo) AS processos
        FROM open_process_control GROUP BY ALL"""
    q["export_csv"] = _export("true", as_text=True)
    movement = "orgao, unidade, tipo_processo, atividade, data, protocolo, qtde".split(", ")
    as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in movement)
    q["export_csv_stock"] = f"SELECT {as_text} FROM stock_movements WHERE {PERIOD}"
    q["export_csv_pages"] = """
        SELECT orgao, unidade,
          regexp_replace(replace(CAST(soma AS VARCHAR), '.', ','), ',0$', '') AS soma
        FROM pages_saved"""
    q["export_csv_blanks"] = (
        "SELECT orgao, '  ' || unidade || ' ' AS unidade, ' ' AS so FROM stock_units"
    )

    q["scope_org_unit"] = f"SELECT * FROM process_lifetime WHERE {SCOPES['org_unit']}"
    q["scope_org_unit_type"] = (
        f"SELECT * FROM stock_movements WHERE {STOCK_SCOPES['org_unit_type']}"
    )
    q["unit_exact"] = f"SELECT * FROM stock_movements WHERE {UNIT}"
    q["unit_with_subunits"] = f"SELECT * FROM stock_movements WHERE {SUBUNITS}"
    q["unit_with_subunits_literal"] = (
        "SELECT * FROM stock_movements WHERE contains(unidade, 'TION_2')"
    )
    q["between_dates"] = f"SELECT * FROM stock_movements WHERE {PERIOD}"
    q["before_date"] = "SELECT * FROM stock_movements WHERE data < DATE '2000-01-01'"
    q["assigned_only"] = "SELECT * FROM assignee_days WHERE atribuido IS NOT NULL"
    q["drop_wildcard_unit"] = "SELECT * FROM stock_units WHERE unidade <> '*'"

    for key, where in SCOPES.items():
        q[f"open_process_count_{key}"] = (
            f"SELECT count(*) AS total FROM open_process_summary WHERE {current(where)}"
        )
        q[f"registered_users_{key}"] = _total(
            "active_users_by_org", "total", AFRICA if "org" in key else "true"
        )
        q[f"median_lifetime_{key}"] = (
            "SELECT quantile_cont(tempo_vida, 0.5) AS mediana "
            f"FROM process_lifetime WHERE {where}"
        )
        q[f"top_process_types_{key}"] = _top_types(where)
        q[f"pages_saved_total_{key}"] = (
            "SELECT round_even(coalesce(sum(soma), 0), 0) AS folhas "
            f"FROM pages_saved WHERE {where}"
        )
        q[f"weekly_evolution_{key}"] = f"""
            SELECT intervalo, total FROM
            (SELECT inicio, intervalo, CAST(sum(total) AS BIGINT) AS total
             FROM weekly_filings WHERE {where} GROUP BY ALL)"""
        q[f"lifetime_by_type_{key}"] = _lifetime_by_type(key, where)
        q[f"assignee_time_{key}"] = _assignee_time(key, where)
        q[f"lifetime_distribution_{key}"] = f"SELECT * FROM process_lifetime WHERE {where}"
        q[f"lifetime_boxes_{key}"] = _boxes(where)
    for key, where in (("all", "true"), ("org", AFRICA)):
        q[f"unit_options_{key}"] = _options(
            "unidade_atual", "current_unit_options", current(where), "Todas"
        )
        q[f"stock_unit_options_{key}"] = _options("unidade", "stock_units", where, "Todas")
    q["type_options"] = """
        SELECT 'Todos' AS opcao UNION ALL
        SELECT DISTINCT tipo_processo FROM stock_movements"""
    q["default_period"] = """
        SELECT CAST(date_trunc('month', max(dta_geracao)) AS DATE) AS inicio,
               CAST(max(dta_geracao) AS DATE) AS fim
        FROM protocolo"""

    for key, where in STOCK_SCOPES.items():
        q[f"stock_flow_{key}"] = _flow(where)
        q[f"stock_balance_{key}"] = _balance(where)
        q[f"stock_chart_{key}"] = _chart(where)
        q[f"open_process_table_{key}"] = (
            f"SELECT {TABLE} FROM open_process_summary WHERE {current(where)}"
        )
        q[f"open_process_export_{key}"] = _export(where)
        q[f"stock_distinct_total_{key}"] = (
            "SELECT count(DISTINCT num_processo) AS total "
            f"FROM open_process_summary WHERE {current(where)}"
        )
        q[f"stock_export_{key}"] = (
            f"SELECT * FROM stock_movements WHERE {PERIOD} AND {where}"
        )
    q["stock_balance_by_unit"] = _balance("true", "orgao, unidade")
    hits = " OR ".join(
        f"contains(lower(CAST({c.strip()} AS VARCHAR)), '5-low')" for c in TABLE.split(",")
    )
    order = (
        "dias_unidade DESC, num_processo, data, tipo_processo, nivel_acesso NULLS FIRST, "
        "unidade_atual, atribuido NULLS FIRST"
    )
    q["table_page"] = (
        f"SELECT {TABLE} FROM open_process_summary WHERE {hits} "
        f"ORDER BY {order} LIMIT 10 OFFSET 20"
    )

    q["table_page_after"] = q["table_page"]
    q["lifetime_by_type_headers"] = _titled(q["lifetime_by_type_org"], fixed.LIFETIME_HEADERS)
    q["assignee_time_headers"] = _titled(q["assignee_time_org"], fixed.ASSIGNEE_HEADERS)

    for key, token in TOKENS.items():
        q[f"authorized_orgs_{key}"] = _authorized(token)
        q[f"restrict_to_orgs_{key}"] = _restricted(token)

    q["project_weekly"] = """
        SELECT ano, semana, inicio, fim, intervalo, CAST(sum(total) AS BIGINT) AS total
        FROM weekly_history GROUP BY ALL"""
    q["project_monthly"] = """
        SELECT ano, mes, periodo, CAST(sum(total) AS BIGINT) AS total
        FROM monthly_filings WHERE ano * 100 + mes >= 199601 GROUP BY ALL"""
    q["project_weekly_range"] = """
        SELECT ano, semana, inicio, fim, intervalo, CAST(sum(total) AS BIGINT) AS total
        FROM weekly_history
        WHERE fim >= DATE '1998-02-10' AND inicio <= DATE '1999-01-05' GROUP BY ALL"""
    q["project_monthly_range"] = """
        SELECT ano, mes, periodo, CAST(sum(total) AS BIGINT) AS total
        FROM monthly_filings WHERE ano * 100 + mes BETWEEN 199802 AND 199901 GROUP BY ALL"""
    off = "s.mediana - g.mediana, s.tipo_processo"
    lifetimes = _lifetime_by_type("org", AFRICA).replace(
        "AS desvio", f"AS desvio, row_number() OVER (ORDER BY {off}) AS posicao"
    )
    q["order_lifetime_by_type"] = lifetimes
    q["order_top_process_types"] = _numbered(_top_types(AFRICA), "total DESC, tipo_processo")
    q["order_assignee_time"] = _numbered(
        _assignee_time("all", "true"), "mediana DESC, atribuido, tipo_processo"
    )
    q["order_weekly_evolution"] = f"""
        SELECT intervalo, CAST(sum(total) AS BIGINT) AS total,
               row_number() OVER (ORDER BY inicio) AS posicao
        FROM weekly_filings WHERE {AFRICA} GROUP BY inicio, intervalo"""
    q["order_unit_options"] = _numbered(q["unit_options_all"], "opcao <> 'Todas', opcao")
    q["order_stock_balance"] = _numbered(_balance("true"), "data")
    q["order_project_monthly"] = _numbered(q["project_monthly"], "ano, mes")
    sunday = _sunday(AS_OF)
    q["migration_ranking_weekly"] = _ranking(
        f"SELECT orgao, sum(total) AS n FROM weekly_history "
        f"WHERE inicio = {sunday} - 7 GROUP BY ALL",
        f"{sunday} - 7",
        sunday,
        5,
    )
    q["migration_ranking_monthly"] = _ranking(
        "SELECT orgao, sum(total) AS n FROM monthly_filings "
        "WHERE ano = 2001 AND mes = 7 GROUP BY ALL",
        "DATE '2001-07-01'",
        "DATE '2001-08-01'",
        30,
    )
    q["date_functions"] = _dates()
    q["number_text"] = f"""
        SELECT unidade, {_dotted("total")} AS total,
               {_dotted("CAST(floor(mediana) AS BIGINT)")}
                   || CASE WHEN mediana > floor(mediana) THEN ',5' ELSE '' END AS mediana
        FROM (SELECT u.unidade, CAST(sum(a.tamanho) AS BIGINT) AS total,
                     quantile_cont(a.tamanho, 0.5) AS mediana
              FROM anexo a JOIN nomes u ON u.id_unidade = a.id_unidade GROUP BY ALL)"""
    return {name: with_parts(text) for name, text in q.items()}


TOKENS = {"wildcard": "tok_100", "single": "tok_1", "expired": "tok_50", "unknown": "none"}
