"""Codes, labels, headers and ratios that results must carry exactly."""

# Source codes
PROCESS = "P"
ACTIVE = "S"
INTERNAL_DOCUMENT = "I"
TASKS_IN = (1, 29, 32)
TASKS_OUT = (28, 41)
ACCESS_LEVELS = {0: "Público", 1: "Restrito", 2: "Sigiloso"}

# Directions of a stock movement
ENTRADA = "Entrada"
SAIDA = "Saída"

# Selector entries
ALL_ORGS = "Todos"
ALL_UNITS = "Todas"
ALL_TYPES = "Todos"
WILDCARD = "*"

# Deviation texts
LATE = "Atrasado"
EARLY = "Adiantado"
EXPECTED = "Dentro do esperado"

# Paper equivalents: bytes per KB, KB per page of an uploaded / a written document
BYTES_PER_KB = 1024
KB_PER_EXTERNAL_PAGE = 335
KB_PER_INTERNAL_PAGE = 37.5

# Weeks shown by the weekly evolution; smallest filing counts that enter a ranking
WEEKS_SHOWN = 10
MIN_WEEKLY_FILINGS = 5
MIN_MONTHLY_FILINGS = 30

# First month of the monthly project evolution
PROJECT_START = "2016-01-01"

# Headers, by column
TABLE_HEADERS = {
    "num_processo": "Processo",
    "data": "Data",
    "tipo_processo": "Tipo de Processo",
    "nivel_acesso": "Nível de Acesso",
    "unidade_atual": "Unidade Atual",
    "dias_unidade": "Dias na unidade",
    "atribuido": "Atribuído para",
}
EXPORT_HEADERS = {
    "num_processo": "Número do processo",
    "data": "Data de autuação",
    "orgao": "Órgão gerador",
    "unidade": "Unidade geradora",
    "tipo_processo": "Tipo de processo",
    "usuario": "Usuário gerador",
    "nivel_acesso": "Nível de acesso",
    "descricao": "Descrição",
    "unidade_atual": "Unidade atual",
    "dias_unidade": "Dias em que o processo está na unidade",
    "tempo_vida": "Tempo de vida",
    "atribuido": "Atribuído para",
}
LIFETIME_HEADERS = {
    "tipo_processo": "Tipo de processo",
    "mediana": "Tempo de vida mediano",
    "desvio": "Diferença com a mediana geral",
}
ASSIGNEE_HEADERS = {
    "atribuido": "Usuário",
    "tipo_processo": "Tipo de processo",
    "mediana": "Tempo mediano",
    "desvio": "Diferença em relação ao tempo mediano",
}
# Over the whole administration the median has another header.
ASSIGNEE_HEADERS_ALL = {
    "atribuido": "Usuário",
    "tipo_processo": "Tipo de processo",
    "mediana": "Tempo de vida mediano",
}

# Processes of a place that one task numbers
NUMBERED_TOGETHER = 20_000
