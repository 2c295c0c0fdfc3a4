"""Texts shown to users. All are fixed values: downstream readers match on them."""

# --- statuses of a baseline recommendation
IMPLEMENTED = "implementada"
NOT_IMPLEMENTED = "não_implementada"
REGRESSION = "regressão"
PARTIAL = "parcial"

# --- recommendations: (priority, category, title, description, impact, complexity, action, savings)
# Placeholders are filled by format_string in the order of the columns named next to each rule.
RECOMMENDATIONS = {
    "idle_cluster": dict(
        category="compute",
        priority="high",
        title="Cluster %s está ocioso",
        description="Cluster %s está ocioso há %.1f horas",
        impact="Alto",
        complexity="Baixa",
        action="Considerar desligar ou reduzir tamanho do cluster",
        estimated_savings="Variável",
    ),
    "abandoned_table": dict(
        category="storage",
        priority="high",
        title="Tabela %s abandonada",
        description="Tabela %s não é acessada há %d dias",
        impact="Alto",
        complexity="Média",
        action="Arquivar ou excluir tabela",
        estimated_savings="%.2f GB",
    ),
    "small_files": dict(
        category="storage",
        priority="medium",
        title="Tabela %s com muitos arquivos pequenos",
        description="Tabela %s tem %d arquivos com média de %.2f MB",
        impact="Médio",
        complexity="Baixa",
        action="Executar OPTIMIZE e Z-ORDER",
        estimated_savings="Melhoria de performance",
    ),
    "failing_job": dict(
        category="pipelines",
        priority="high",
        title="Job %s com alta taxa de falha",
        description="Job %s tem %.1f%% de falhas",
        impact="Alto",
        complexity="Alta",
        action="Investigar e corrigir causas de falha",
        estimated_savings="Redução de retrabalho",
    ),
}

# --- audit issues: (category, description, recommended action, estimated impact)
ISSUES = {
    "missing_optimize": (
        "storage",
        "Tabela Delta sem OPTIMIZE: %d arquivos, média %.2f MB",
        "Executar OPTIMIZE ZORDER BY (colunas de join)",
        "Redução de %.0f arquivos, melhoria de 30-50%% em queries",
    ),
    "abandoned_table": (
        "storage",
        "Tabela abandonada: %d dias sem acesso, %.2f GB",
        "Arquivar ou excluir tabela",
        "Economia de %.2f GB de storage",
    ),
    "idle_cluster": (
        "compute",
        "Cluster ocioso há %.1f horas",
        "Desligar cluster ou configurar autotermination",
        "Economia estimada: %.2f USD",
    ),
    "high_failure_job": (
        "compute",
        "Job com %.1f%% de falhas em %d execuções",
        "Investigar logs, corrigir erros, implementar retry inteligente",
        "Redução de %.1f horas de retrabalho/semana",
    ),
    "missing_autoscaling": (
        "compute",
        "Cluster com %d workers fixos sem autoscaling",
        "Configurar autoscaling baseado em carga",
        "Economia estimada: 20-40% em custos de compute",
    ),
    "job_without_schedule": (
        "pipelines",
        "Job sem schedule definido, execução manual",
        "Definir schedule apropriado ou considerar remoção",
        "Melhoria de governança e previsibilidade",
    ),
    "long_running_job": (
        "pipelines",
        "Job executando por %.1f horas",
        "Otimizar query, particionar dados, revisar lógica",
        "Redução de custo e melhoria de SLA",
    ),
}

MARGIN_OF_ERROR = "±15%"
OPTIMIZE_GAIN = "30-50% em queries"
FAILURE_ADVICE = "Investigar causa raiz e implementar correção"
WASTE_ADVICE = "Corrigir falhas pode economizar $%.2f/mês e melhorar SLA"
QUICK_WIN_CLUSTER = "Cluster %s ocioso"
QUICK_WIN_TABLE = "Tabela %s abandonada"

# --- automation: text only, nothing is ever executed
STOP_COMMAND = "databricks clusters delete --cluster-id %s"
START_COMMAND = "databricks clusters start --cluster-id %s"
IDLE_CONDITION = "idle_hours > %.1f"
IDLE_ALERT = "Cluster %s está ocioso há %.1f horas. Considere desligar."
ALERT_TITLE = "Oportunidade de Automação: %s"

# --- labels of the published report queries
PERCENTILES = {
    "excellent": "Top 10% da indústria",
    "good": "Top 25% da indústria",
    "average": "Mediana da indústria",
}
PERCENTILE_OTHER = "Abaixo da mediana"
ROI_ADVICE = {
    "high": "ROI confiável para apresentação executiva",
    "medium": "ROI aceitável, revisar antes de apresentar",
}
ROI_ADVICE_OTHER = "ROI requer validação adicional"
SCHEDULED, MANUAL = "Agendado", "Manual"
CLUSTER_STATUS = ((4.0, "Ocioso"), (2.0, "Subutilizado"))
CLUSTER_ACTIVE = "Ativo"
CLUSTER_CLASSES = ((0.8, "Otimizado"), (0.6, "Bom"), (0.4, "Regular"))
CLUSTER_WORST = "Ruim"
TABLE_GONE, TABLE_COLD, TABLE_ACTIVE = "Abandonada", "Fria", "Ativa"
TABLE_ACTIONS = {"high": "Ação Imediata", "medium": "Planejar Ação"}
TABLE_WATCH = "Monitorar"
JOB_STATUS = ((0.2, "Crítico"), (0.1, "Atenção"))
JOB_OK = "OK"
COLD_RISK = ((30.0, "Alto"), (15.0, "Médio"))
COLD_LOW = "Baixo"
