"""Schemas of the source tables and of the marts, as DDL."""

from pyspark.sql.types import StructType

CASE_TABLES = {
    "orgao": "id_orgao BIGINT, sigla STRING, sin_ativo STRING",
    "unidade": "id_unidade BIGINT, id_orgao BIGINT, sigla STRING",
    "usuario": "id_usuario BIGINT, id_orgao BIGINT, nome STRING, sin_ativo STRING",
    "protocolo": (
        "id_protocolo BIGINT, protocolo_formatado STRING, sta_protocolo STRING, "
        "dta_geracao TIMESTAMP, id_unidade_geradora BIGINT, id_usuario_gerador BIGINT, "
        "sta_nivel_acesso_global INT, descricao STRING"
    ),
    "procedimento": "id_procedimento BIGINT, id_tipo_procedimento BIGINT",
    "tipo_procedimento": "id_tipo_procedimento BIGINT, nome STRING",
    "atividade": (
        "id_atividade BIGINT, id_protocolo BIGINT, id_unidade BIGINT, id_tarefa INT, "
        "dth_abertura TIMESTAMP, dth_conclusao TIMESTAMP, id_usuario_atribuicao BIGINT"
    ),
    "anexo": "id_unidade BIGINT, tamanho BIGINT",
    "documento": "id_documento BIGINT, id_unidade_responsavel BIGINT, sta_documento STRING",
    "documento_conteudo": "id_documento BIGINT, conteudo STRING",
}

# Tables that grow with the cases, and the number by which a database splits them.
SPLIT_KEYS = {
    "protocolo": "id_protocolo",
    "procedimento": "id_procedimento",
    "atividade": "id_atividade",
    "anexo": "id_unidade",
    "documento": "id_documento",
    "documento_conteudo": "id_documento",
    "usuario": "id_usuario",
}

# Kept in a second database. `acesso_orgao` is that database's own list of
# organisations, renamed so that it does not hide the case-file one; its short name is
# called `sigla` here too.
ACCESS_TABLES = {
    "auth": "token STRING, id_user BIGINT, created_at TIMESTAMP",
    "permissao": "id_user BIGINT, id_orgao BIGINT",
    "acesso_orgao": "id BIGINT, sigla STRING",
}

MARTS = {
    "active_orgs": "sigla STRING",
    "processes_by_org_unit": "orgao STRING, unidade STRING, total BIGINT",
    "active_users_by_org": "orgao STRING, total BIGINT",
    "distinct_process_types": "total BIGINT",
    "process_types_by_org_unit": (
        "orgao STRING, unidade STRING, tipo_processo STRING, total BIGINT"
    ),
    "weekly_filings": (
        "orgao STRING, unidade STRING, ano INT, semana INT, inicio DATE, fim DATE, "
        "intervalo STRING, total BIGINT"
    ),
    "weekly_history": (
        "orgao STRING, unidade STRING, ano INT, semana INT, inicio DATE, fim DATE, "
        "intervalo STRING, total BIGINT"
    ),
    "monthly_filings": "orgao STRING, ano INT, mes INT, periodo STRING, total BIGINT",
    "stock_movements": (
        "orgao STRING, unidade STRING, tipo_processo STRING, atividade STRING, "
        "data DATE, protocolo BIGINT, qtde BIGINT"
    ),
    "open_process_control": (
        "orgao STRING, unidade STRING, num_processo STRING, ano INT, mes INT, dia INT, "
        "usuario STRING, tipo_processo STRING, nivel_acesso STRING, descricao STRING, "
        "unidade_atual STRING, orgao_atual STRING, dias_unidade BIGINT, "
        "tempo_vida BIGINT, atribuido STRING, data STRING, data_filtro DATE"
    ),
    "process_lifetime": (
        "orgao STRING, unidade STRING, tipo_processo STRING, tempo_vida BIGINT"
    ),
    "external_pages": "orgao STRING, unidade STRING, folhas DOUBLE",
    "internal_pages": "orgao STRING, unidade STRING, folhas DOUBLE",
    # Derived from the marts above
    "stock_units": "orgao STRING, unidade STRING",
    "open_process_summary": (
        "num_processo STRING, data STRING, tipo_processo STRING, nivel_acesso STRING, "
        "unidade_atual STRING, dias_unidade BIGINT, atribuido STRING, "
        "data_filtro DATE, orgao_atual STRING"
    ),
    "current_unit_options": "orgao_atual STRING, unidade_atual STRING",
    "assignee_days": (
        "orgao STRING, unidade_atual STRING, tipo_processo STRING, atribuido STRING, "
        "dias_unidade BIGINT"
    ),
    "pages_saved": "orgao STRING, unidade STRING, soma DOUBLE",
    "lifetime_counts": (
        "orgao STRING, unidade STRING, tipo_processo STRING, tempo_vida BIGINT, "
        "processos BIGINT"
    ),
    "days_in_unit_counts": (
        "orgao STRING, unidade_atual STRING, tipo_processo STRING, atribuido STRING, "
        "dias_unidade BIGINT, atividades BIGINT"
    ),
    # Open activities with the assignee (`nivel` 0) and without (`nivel` 1)
    "open_activity_rollup": (
        "nivel INT, orgao STRING, unidade_atual STRING, tipo_processo STRING, "
        "atribuido STRING, dias_unidade BIGINT, atividades BIGINT"
    ),
    "days_in_unit_totals": (
        "orgao STRING, unidade_atual STRING, tipo_processo STRING, dias_unidade BIGINT, "
        "atividades BIGINT"
    ),
    # Sets of process numbers: a bit for each number of a bucket
    "open_process_bitmaps": (
        "orgao_atual STRING, unidade_atual STRING, tipo_processo STRING, balde BIGINT, "
        "mapa BINARY"
    ),
    "stock_daily": (
        "orgao STRING, unidade STRING, tipo_processo STRING, atividade STRING, "
        "data DATE, qtde BIGINT"
    ),
    "lifetime_median_by_type": "tipo_processo STRING, mediana DOUBLE",
    "days_in_unit_median_by_type": "tipo_processo STRING, mediana DOUBLE",
    "lifetime_first_quartile": "q1 DOUBLE",
}


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
