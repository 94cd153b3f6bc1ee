"""Names, weights, thresholds, patterns and texts that results depend on."""

# --- dimensions -------------------------------------------------------------
DIMENSIONS = ("completude", "unicidade", "consistencia", "validade", "integridade", "freshness")

# --- weights ----------------------------------------------------------------
WEIGHTS = {
    "scan": {
        "completude": 0.25, "unicidade": 0.20, "consistencia": 0.15,
        "validade": 0.15, "integridade": 0.15, "freshness": 0.10,
    },
    "star": {
        "completude": 0.20, "unicidade": 0.15, "consistencia": 0.20,
        "validade": 0.15, "integridade": 0.15, "freshness": 0.15,
    },
}
TABLE_WEIGHTS = {"score_completeness": 0.6, "score_uniqueness": 0.3, "score_volume": 0.1}
COLUMN_WEIGHTS = {"completeness": 0.7, "uniqueness": 0.3}

# --- thresholds: (lower bound, value), highest first --------------------------
BANDS = {
    "scan": ((9.0, "Excelente"), (7.0, "Bom"), (5.0, "Atenção")),
    "report": ((7.0, "Bom"), (5.0, "Atenção")),
    "radar": ((8.0, "Excelente"), (6.0, "Atenção")),
}
LOWEST_BAND = "Crítico"
NO_BAND = "Sem classificação"
VOLUME_STEPS = ((1000, 10.0), (100, 7.0), (10, 4.0))
VOLUME_MIN = 1.0
PENALTY_STEPS = ((0.30, -6.0), (0.10, -4.0), (0.0, -2.0))
PRIORITY_STEPS = ((15, "Imediata"), (10, "Alta"), (6, "Média"))
PRIORITY_MIN = "Baixa"
SLA_HOURS = 24.0
PASTED_CSV_SHARE = 0.6
PASTED_CSV_COMMAS = 3

# --- patterns ---------------------------------------------------------------
ID_PATTERN = r"(?i)(^id$|^id_|_id$|codigo|chave|key)"
DATE_PATTERN = r"(?i)(date|data|dt_|_dt|timestamp|measured_at|created|updated)"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ALNUM_PATTERN = r"^[A-Za-z0-9\-_]+$"
DATE_TOKENS = ("data", "dt", "date", "updated", "update", "created")
ID_TOKENS = ("id", "codigo", "cd", "cod")
EMAIL_TOKEN = "email"

# Characters that Python's str.strip() removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts a CSV cell may hold for "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# --- labels and texts ---------------------------------------------------------
LABEL_COLUMNS = (
    "dataset_label", "dataset_name", "dataset", "object_name", "source_name",
    "table_name", "file_name", "source_ref", "source",
)
LABEL_DEFAULT = "Dataset não identificado"
SCORE_COLUMNS = ("score", "score_final", "score_base")
CLASS_COLUMNS = ("classification", "classificacao")
NO_DATA = "Sem dados"
PRIORITY_UNSET = "Não definida"
DATASET_UNSET = "Não informado"
NO_VALUES = "sem valores não nulos"
COLUMN_ABSENT = "coluna não encontrada no dataset"
RULE_DETAILS = {
    "not_null": "preenchimento=%.4f",
    "unique": "unicidade=%.4f",
    "regex": "aderência_regex=%.4f",
    "range": "aderência_range=%.4f",
    "allowed_values": "aderência_allowed=%.4f",
}
RULE_IGNORED = "regra_ignorada=%s"
RULE_ERROR = "erro_regra=%s: %s"

METRIC_MEANINGS = {
    "score_final": "qualidade geral do dataset",
    "score_completeness": "poucos valores nulos (completude)",
    "score_uniqueness": "boa diversidade de valores (unicidade)",
    "score_volume": "volume de linhas (amostra)",
    "null_rate": "percentual de células nulas",
    "avg_distinct_ratio": "unicidade média das colunas",
}

# Ordered: the first group with a hit names the theme.
THEME_KEYWORDS = (
    ("Completude", ("null", "nulo", "falt", "missing", "complet")),
    ("Unicidade", ("duplic", "unique", "unic")),
    ("Validade", ("regex", "formato", "pattern", "padrao", "válid", "valid")),
    ("Consistência", ("range", "faixa", "limite", "interval")),
    ("Atualidade", ("fresh", "atual", "recen")),
)
THEME_DEFAULT = "Qualidade Geral"

DIMENSION_LABELS = {
    "completude": "Completude", "unicidade": "Unicidade", "consistencia": "Consistência",
    "validade": "Validade", "integridade": "Integridade", "freshness": "Atualidade",
}
# Lowest dimension -> (root cause, recommendation).
DIMENSION_ADVICE = {
    "Completude": (
        "Campos obrigatórios sem preenchimento consistente na origem.",
        "Aplicar obrigatoriedade, preenchimento default controlado e monitoração de nulos.",
    ),
    "Consistência": (
        "Regras cruzadas entre colunas não estão sendo validadas.",
        "Criar validações de coerência na ingestão e na camada analítica.",
    ),
    "Unicidade": (
        "Não existe chave única confiável ou deduplicação por negócio.",
        "Implementar chave de negócio e deduplicação antes da persistência final.",
    ),
    "Validade": (
        "Formato, domínio ou tipagem chegam inválidos.",
        "Padronizar regex, domínio permitido e casting controlado.",
    ),
    "Atualidade": (
        "SLA de atualização não está sendo cumprido.",
        "Revisar agenda, carga incremental e monitoramento do atraso.",
    ),
    "Integridade": (
        "Existem chaves órfãs ou quebra de referência entre entidades.",
        "Aplicar validação referencial e reconciliação automática.",
    ),
}
ADVICE_DEFAULT = ("Causa raiz ainda não classificada.", "Revisar regras e padrão de origem.")

ADVICE_NULLS = "Alta quantidade de nulos. Recomenda-se validação obrigatória na origem."
ADVICE_DUPLICATES = "Duplicidade detectada. Implementar chave única."
ADVICE_NONE = "Sem problemas críticos."
ADVICE_NULL_SHARE = 0.2
ADVICE_DUPLICATE_SHARE = 0.05

REVIEW_TEXT = "Revisar a coluna %s do dataset %s."
REVIEW_EMPTY = "Nenhuma recomendação disponível para o run atual."
SUMMARY_TEXT = (
    "Foram avaliadas %d fontes de dados, com score executivo médio de %.2f e classificação geral '%s'. "
    "O resultado pede plano de ação priorizado, com foco em consistência, completude e monitoramento contínuo. "
    "Foram identificadas %d fontes críticas e %d em atenção."
)

RUN_ID_FORMAT = "%Y%m%d_%H%M%S"
