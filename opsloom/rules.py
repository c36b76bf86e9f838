"""Word lists, patterns, lookup tables and weights.

These must equal the specified behaviour for results to be right, so they are
stated as they are. Everything that applies them is in the other modules.
"""

# ---------------------------------------------------------------- fixed values: log layouts
# Common field order of every layout: timestamp, level, thread, service, ip, component, message.
ISO_TS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z?"
ISO_TS_MS_Z = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z"
ISO_TS_SECONDS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
LEVEL_WORDS = "DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL"

LINE_LAYOUTS = [
    ("standard", rf"^({ISO_TS_MS_Z})\s+\[(\w+)\]\s+([\w-]+):\s+(.*)$", ("ts", "level", "service", "message")),
    ("simple", rf"^({ISO_TS_SECONDS})\s+\[(\w+)\]\s+(.*)$", ("ts", "level", "message")),
]
ENTRY_LAYOUTS = [
    ("standard", rf"^({ISO_TS})\s+\[(\w+)\]\s+([\w-]+):\s+(.*)$", ("ts", "level", "service", "message")),
    ("with_host", rf"^({ISO_TS})\s+\[(\w+)\]\s+([\w-]+)@(\d+\.\d+\.\d+\.\d+):\s+(.*)$",
     ("ts", "level", "service", "ip", "message")),
    ("detailed", rf"^({ISO_TS})\s+\[(\w+)\]\s+\[([\w-]+)\]\s+([\w-]+):\s+(?:([\w.]+):\s+)?(.*)$",
     ("ts", "level", "thread", "service", "component", "message")),
]
EXTENDED_LAYOUTS = [
    ("thread", rf"^({ISO_TS})\s+\[(\w+)\s*\]\s+([\w-]+)\s+([\w-]+):\s+(.*)$",
     ("ts", "level", "service", "thread", "message")),
    ("service_first", rf"^({ISO_TS})\s+([\w-]+)\s+({LEVEL_WORDS}):\s+(.*)$", ("ts", "service", "level", "message")),
    ("comma_ms", rf"^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}},\d{{3}})\s+([\w-]+)\s+(\w+)\s+(\w+):\s+(.*)$",
     ("ts", "service", "level", "component", "message")),
    ("blank_date", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+([\w-]+):\s+(.*)$",
     ("ts", "level", "service", "message")),
]
# Layouts of other programs: field name per group.
FOREIGN_LAYOUTS = [
    ("apache_combined", r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\S+)',
     ("ip", "timestamp", "method", "path", "protocol", "status", "size")),
    ("nginx_error", r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+): (.*)",
     ("timestamp", "level", "pid", "tid", "message")),
    ("application_json", r"^\{.*\}$", ()),
    ("syslog", r"^(\w{3} \d{2} \d{2}:\d{2}:\d{2}) (\S+) (\S+): (.*)",
     ("timestamp", "hostname", "program", "message")),
]
FILE_HOSTS = [("service_b", "service-b", "d1-app-01"), ("service_a", "service-a", "d1-app-02")]

# ---------------------------------------------------------------- fixed values: log message fields
REQUEST_ID = r"(?i)request[_-]?id[:\s=]+([a-zA-Z0-9-]+)"
ERROR_CODE = r"(?i)error[_\s]?code[:\s=]+([A-Z0-9_]+)"
DURATION_MS = r"(\d+(?:\.\d+)?)\s*ms"
CPU_PERCENT = r"(?i)CPU[:\s]*(\d+(?:\.\d+)?)%"
MEMORY_SIZE = r"(?i)Memory[:\s]*(\d+(?:\.\d+)?)\s*(MB|GB)"
DOTTED_QUAD = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
TOPIC_TAGS = [
    ("network", ["timeout", "connection", "refused"]),
    ("memory", ["memory", "heap", "oom"]),
    ("disk", ["disk", "i/o", "space"]),
    ("database", ["database", "sql", "connection pool"]),
]
TEMPLATE_STEPS = [
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z?", ""),
    (r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "[ID]"),
    (r"[a-zA-Z0-9]{20,}", "[LONG_ID]"),
    (r"\d+\.\d+", "[NUMBER]"),
    (r"\b\d+\b", "[NUM]"),
]
SUMMARY_RULES = [
    (["cpu"], " experiencing high CPU usage"),
    (["memory", "heap"], " has memory issues"),
    (["disk", "i/o"], " encountering disk I/O problems"),
    (["timeout", "connection"], " has connectivity issues"),
]
CATEGORY_RULES = [
    (["cpu", "memory", "heap", "gc"], "performance_issue"),
    (["timeout", "connection", "network"], "connectivity_issue"),
    (["disk", "i/o", "space"], "storage_issue"),
    (["database", "sql", "query"], "database_issue"),
]
LEVEL_SEVERITY = {"INFO": 0.1, "WARN": 0.4, "ERROR": 0.7, "CRITICAL": 0.9}
SEVERITY_BONUS = {
    "critical": 0.2, "outofmemory": 0.25, "timeout": 0.15, "failed": 0.1,
    "exception": 0.1, "unable": 0.1, "denied": 0.1,
}
LOG_KEYWORDS = [
    "cpu", "memory", "disk", "network", "io", "latency", "throughput",
    "error", "exception", "timeout", "connection", "gc", "heap",
    "pool", "queue", "batch", "request", "response",
    "failed", "success", "warning", "critical", "started", "stopped",
    "restart", "killed", "healthy", "unhealthy",
]
LOG_METRICS = [r"(\d+)%", r"(\d+)ms", r"(\d+)mb", r"(\d+)gb", r"(\d+)/(\d+)"]
LOG_SERVICES = ["service-[a-z]", "api-gateway", "database", "redis", "nginx"]
LOG_TECH = ["mysql", "redis", "nginx", "kubernetes", "docker", "java", "python", "node", "elasticsearch"]
LOG_CATEGORY = "系统日志"
FILE_PROBLEMS = [
    ("cpu", "cpu_overload"), ("disk", "disk_io_bottleneck"),
    ("network", "network_partition"), ("memory", "memory_leak"),
]
FILE_SERVICES = [("service_a", "service-a"), ("service_b", "service-b"), ("service_c", "service-c")]

# ---------------------------------------------------------------- fixed values: documents
WIKI_TECH_WORDS = [
    "kubernetes", "docker", "mysql", "redis", "nginx", "prometheus",
    "grafana", "elasticsearch", "kafka", "rabbitmq", "mongodb",
    "postgresql", "jenkins", "gitlab", "jira", "api", "microservice",
    "cpu", "memory", "disk", "network", "monitoring", "alerting",
]
WIKI_OPS_WORDS = [
    "故障", "排查", "监控", "告警", "性能", "优化", "部署", "配置",
    "备份", "恢复", "安全", "日志", "指标", "健康检查",
]
WIKI_SERVICES = ["service-[a-z]", "api-gateway", "database", "web-server"]
WIKI_TECH = ["kubernetes", "docker", "mysql", "redis", "nginx", "prometheus"]
CODE_SUFFIXES = ["py", "java", "js", "go", "cpp"]
CHANGE_WORDS = ["bug", "feature", "fix"]
CHANGE_LABELS = ["backend", "frontend", "database", "api"]
TICKET_WORDS = ["故障", "异常", "错误", "超时", "连接", "性能", "监控", "cpu", "memory", "disk", "network"]
TICKET_TECH = ["kubernetes", "docker", "mysql", "redis", "nginx"]
DOCUMENT_DEFAULTS = {
    "wiki": ("知识文档", "系统"), "gitlab": ("代码变更", ""), "jira": ("工单", ""), "logs": (LOG_CATEGORY, ""),
}
CHUNK_SIZE = 512
SENTENCE_END = "。"
SOLUTION_WORDS = ["解决方案", "solution", "解决", "fix", "处理方法"]
PRACTICE_WORDS = ["最佳实践", "best practice", "建议", "recommendation", "优化"]
CASE_WORDS = ["案例", "解决", "处理", "方案"]
SOURCE_DISPLAY = [
    ("wiki", "Wiki知识库", "知识文档"), ("jira", "JIRA工单系统", "工单记录"), ("gitlab", "GitLab项目", "代码仓库"),
]

# ---------------------------------------------------------------- fixed values: requests
CONTEXT_SERVICES = ["service-a", "service-b", "service-c", "service-d", "service-e"]
CONTEXT_LEVELS = ["error", "warn", "info", "debug", "critical"]
CONTEXT_HOSTS = ["d1-app-01", "d1-app-02", "d2-app-01", "d2-app-02"]
RECENT_WORD = "最近"
# "CPU" stays upper case as specified: it is compared with lowered text and never matches.
INCIDENT_QUESTION_WORDS = [
    "故障", "问题", "错误", "异常", "超时", "慢", "卡顿", "宕机",
    "CPU", "内存", "磁盘", "网络", "数据库", "服务", "分析", "原因",
    "排查", "诊断", "修复", "解决", "incident", "root cause",
    "error", "failure", "timeout", "slow", "crash", "down",
    "performance", "issue", "problem", "troubleshoot", "debug",
    "analyze", "diagnosis", "fix", "solve", "service-", "database",
]
PROBLEM_TYPES = [
    ("troubleshooting", "故障|问题|错误|异常|失败|不工作|无法|报警"),
    ("optimization", "优化|提升|改进|性能|效率|加速"),
    ("deployment", "部署|发布|上线|安装|配置"),
    ("monitoring", "监控|告警|日志|指标|观测"),
]
REQUEST_WORDS = [
    "cpu", "内存", "磁盘", "网络", "数据库", "服务", "容器", "kubernetes",
    "mysql", "redis", "nginx", "apache", "docker", "监控", "日志",
    "性能", "优化", "故障", "报警", "部署", "配置",
]
PRIORITY_PATTERNS = [
    ("high", "紧急|严重|宕机|无法访问|生产环境|critical|urgent|用户反馈|客户投诉|业务影响"),
    ("medium", "异常|错误|警告|慢|延迟|优化|改进|升级"),
]
COMPLEXITY_PATTERNS = [
    ("high", "架构|重构|迁移|集群|分布式|multi|cluster|architecture"),
    ("medium", "配置|部署|优化|监控|集成|config|deploy|optimize|integrate"),
]

# ---------------------------------------------------------------- fixed values: search
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
RERANK_ALPHA = 0.7
CONTENT_ALPHA = 0.6
CONTENT_BM25_SCALE = 3.0
CAPPED_BM25_SCALE = 10.0
VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
RANK_FUSION_K = 60
GRAPH_HIT_SCORE = 0.7
ENTITY_HIT_SCORE = 1.0
LEADER_THRESHOLD = 0.8
QUERY_PREFIX = "运维问题 故障排查 "
KNOWLEDGE_QUERY_SUFFIX = " 故障排查 troubleshooting 根因分析"
SUGGESTIONS = [
    "CPU使用率高", "内存泄露问题", "数据库连接失败", "服务重启",
    "网络延迟", "磁盘空间不足", "日志错误", "性能优化",
]

# ---------------------------------------------------------------- fixed values: root-cause analysis
RELEVANCE_WORDS = ["error", "exception", "fail", "timeout", "crash", "down"]
KNOWLEDGE_TERMS = ["故障", "排查", "根因", "解决", "troubleshoot", "diagnose", "fix", "resolve"]
ENTITY_TYPE_RELEVANCE = [
    (0.4, ["SERVICE", "ERROR", "ALERT"]), (0.3, ["DATABASE", "SERVER", "CONTAINER"]), (0.2, ["METRIC", "LOG_LEVEL"]),
]
CRITICAL_EVENT_WORDS = ["crash", "fail", "timeout", "exception", "down"]
QUESTION_SYMPTOMS = [
    ("cpu", "performance", "CPU使用率过高", "high"),
    ("memory", "performance", "内存使用异常", "high"),
    ("内存", "performance", "内存问题", "high"),
    ("timeout", "performance", "响应超时", "high"),
    ("slow", "performance", "响应缓慢", "medium"),
    ("error", "functional", "功能错误", "medium"),
    ("connection", "connectivity", "连接问题", "high"),
    ("disk", "performance", "磁盘IO问题", "medium"),
]
FAILURE_WORDS = ["critical", "error", "failure", "异常", "错误"]
SYMPTOM_WORDS = [
    ("performance", ["慢", "延迟", "卡顿", "timeout", "slow", "latency"]),
    ("error", ["错误", "异常", "失败", "error", "exception", "failure"]),
    ("resource", ["内存", "cpu", "磁盘", "network", "memory", "disk"]),
    ("availability", ["宕机", "无法访问", "down", "unavailable", "offline"]),
]
HIGH_SEVERITY_WORDS = ["宕机", "无法访问", "生产环境", "紧急", "critical"]
MEDIUM_SEVERITY_WORDS = ["错误", "异常", "失败"]
CAUSES_OF_SYMPTOM = [
    ("performance", "资源不足", 0.7, "resource"),
    ("performance", "数据库查询慢", 0.6, "database"),
    ("performance", "网络延迟", 0.5, "network"),
    ("error", "配置错误", 0.8, "configuration"),
    ("error", "代码bug", 0.6, "software"),
    ("error", "依赖服务异常", 0.7, "dependency"),
    ("resource", "资源泄露", 0.8, "software"),
    ("resource", "负载过高", 0.7, "capacity"),
    ("resource", "配置不当", 0.6, "configuration"),
    ("availability", "服务崩溃", 0.9, "software"),
    ("availability", "硬件故障", 0.6, "hardware"),
    ("availability", "网络中断", 0.5, "network"),
]
# cause type, solution, feasibility, impact, risk, hours; "" is every other type
SOLUTIONS_OF_CAUSE = [
    ("resource", "增加系统资源配置", 0.8, 0.9, 0.3, 2.0),
    ("resource", "优化资源使用效率", 0.9, 0.7, 0.2, 4.0),
    ("configuration", "检查和修正配置", 0.9, 0.8, 0.4, 1.0),
    ("software", "修复软件问题", 0.7, 0.9, 0.5, 8.0),
    ("software", "重启相关服务", 1.0, 0.6, 0.3, 0.5),
    ("", "进一步诊断和分析", 1.0, 0.5, 0.1, 2.0),
]
SOLUTION_STEPS = {
    "增加系统资源配置": ["评估资源需求", "申请资源扩容", "执行扩容操作", "验证效果"],
    "优化资源使用效率": ["分析资源使用", "识别优化点", "实施优化", "性能测试"],
    "检查和修正配置": ["备份现有配置", "检查配置文件", "修正错误配置", "重启服务"],
    "修复软件问题": ["代码审查", "定位bug", "修复代码", "测试验证", "发布更新"],
    "重启相关服务": ["准备重启", "重启服务", "验证服务状态"],
    "进一步诊断和分析": ["收集更多信息", "深入分析", "制定具体方案"],
}
RISK_BANDS = [
    (0.7, "高风险：建议在维护窗口执行"), (0.4, "中等风险：建议做好备份和回滚准备"),
    (-1.0, "低风险：可以考虑在业务时间执行"),
]
SUCCESS_METRICS = {
    "performance": ["响应时间恢复正常", "CPU/内存使用率降低", "错误率减少"],
    "availability": ["服务可正常访问", "健康检查通过", "监控告警清除"],
    "": ["问题症状消失", "系统运行稳定", "相关指标恢复正常"],
}
# keyword tests on the cause text, solution, priority, minutes
CAUSE_SOLUTIONS = [
    ("CPU", "扩容CPU资源或优化CPU密集型操作", "high", 30),
    ("内存使用情况", "监控内存使用趋势，根据需要调整内存分配", "medium", 20),
    ("内存", "检查内存泄露，重启相关服务", "high", 15),
    ("依赖", "检查依赖服务状态，修复服务间通信", "medium", 45),
    ("主机", "检查主机资源使用情况，考虑迁移服务", "medium", 60),
    ("连接", "检查网络连接和防火墙配置", "high", 20),
]

# ---------------------------------------------------------------- fixed values: entities and relations
ENTITY_PATTERNS = [
    ("SERVICE", r"\b\w+[-_]?service\b"),
    ("SERVICE", r"\b\w+[-_]?api\b"),
    ("SERVICE", r"\bmicroservice[-_]?\w*\b"),
    ("DATABASE", r"\bmysql\b"),
    ("DATABASE", r"\bredis\b"),
    ("DATABASE", r"\bmongodb\b"),
    ("DATABASE", r"\bpostgresql\b"),
    ("DATABASE", r"\belasticsearch\b"),
    ("SERVER", r"\b\w+[-_]server[-_]?\d*\b"),
    ("SERVER", r"\bhost[-_]?\w*\b"),
    ("SERVER", r"\bnode[-_]?\d+\b"),
    ("CONTAINER", r"\bpod[-_]?\w*\b"),
    ("CONTAINER", r"\bcontainer[-_]?\w*\b"),
    ("CONTAINER", r"\bdocker[-_]?\w*\b"),
    ("ERROR", r"\b\w*error\w*\b"),
    ("ERROR", r"\b\w*exception\w*\b"),
    ("ERROR", r"\b\w*failure\w*\b"),
    ("METRIC", r"\bcpu\s+usage\b"),
    ("METRIC", r"\bmemory\s+usage\b"),
    ("METRIC", r"\bdisk\s+space\b"),
    ("METRIC", r"\blatency\b"),
    ("METRIC", r"\bthroughput\b"),
    ("LOG_LEVEL", r"\b(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"),
]
IP_PATTERN = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)
TIMESTAMP_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z?",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}",
]
RELATION_PATTERNS = [
    ("DEPENDS_ON", r"(\w+)\s+depends\s+on\s+(\w+)"),
    ("DEPENDS_ON", r"(\w+)\s+requires\s+(\w+)"),
    ("DEPENDS_ON", r"(\w+)\s+needs\s+(\w+)"),
    ("CONNECTS_TO", r"(\w+)\s+connects?\s+to\s+(\w+)"),
    ("CONNECTS_TO", r"(\w+)\s+links?\s+to\s+(\w+)"),
    ("CONNECTS_TO", r"(\w+)\s+communicates?\s+with\s+(\w+)"),
    ("HOSTS", r"(\w+)\s+hosts?\s+(\w+)"),
    ("HOSTS", r"(\w+)\s+runs?\s+on\s+(\w+)"),
    ("HOSTS", r"(\w+)\s+deployed\s+on\s+(\w+)"),
    ("CAUSES", r"(\w+)\s+causes?\s+(\w+)"),
    ("CAUSES", r"(\w+)\s+triggers?\s+(\w+)"),
    ("CAUSES", r"(\w+)\s+leads?\s+to\s+(\w+)"),
    ("MONITORS", r"(\w+)\s+monitors?\s+(\w+)"),
    ("MONITORS", r"(\w+)\s+watches?\s+(\w+)"),
    ("MONITORS", r"(\w+)\s+observes?\s+(\w+)"),
    ("AFFECTS", r"(\w+)\s+affects?\s+(\w+)"),
    ("AFFECTS", r"(\w+)\s+impacts?\s+(\w+)"),
    ("AFFECTS", r"(\w+)\s+influences?\s+(\w+)"),
]
NEAR_PAIR_RULES = [
    ("SERVICE", "DATABASE", "USES"),
    ("SERVICE", "SERVER", "RUNS_ON"),
    ("CONTAINER", "SERVER", "DEPLOYED_ON"),
    ("ERROR", "SERVICE", "AFFECTS"),
    ("METRIC", "SERVICE", "MEASURES"),
    ("ALERT", "ERROR", "TRIGGERED_BY"),
]
NEAR_PAIR_GAP = 50
QUESTION_PATTERNS = [
    ("SERVICE", 0.9, r"service-[a-zA-Z]\d*"),
    ("SERVICE", 0.9, r"service\s+[A-Za-z]\d*"),
    ("SERVICE", 0.9, r"[Ss]ervice[_\-\s]*[A-Za-z]\d*"),
    ("COMPONENT_DATABASE", 0.8, r"\b(数据库|database|db|mysql|postgresql|redis|mongo)\b"),
    ("COMPONENT_NETWORK", 0.8, r"\b(网络|network|网卡|交换机|路由器|防火墙)\b"),
    ("COMPONENT_STORAGE", 0.8, r"\b(存储|storage|磁盘|disk|硬盘|SSD|HDD)\b"),
    ("COMPONENT_CPU", 0.8, r"\b(CPU|cpu|处理器|processor)\b"),
    ("COMPONENT_MEMORY", 0.8, r"\b(内存|memory|RAM|ram)\b"),
    ("COMPONENT_LOAD_BALANCER", 0.8, r"\b(负载均衡|load\s*balancer|LB|lb)\b"),
    ("INCIDENT_PERFORMANCE", 0.7, r"\b(性能|performance|slow|慢|卡顿|延迟|latency)\b"),
    ("INCIDENT_ERROR", 0.7, r"\b(错误|error|异常|exception|故障|failure|问题|problem)\b"),
    ("INCIDENT_TIMEOUT", 0.7, r"\b(超时|timeout|time\s*out)\b"),
    ("INCIDENT_CONNECTION", 0.7, r"\b(连接|connection|connect|网络中断|断开)\b"),
    ("INCIDENT_CRASH", 0.7, r"\b(崩溃|crash|宕机|down|offline)\b"),
    ("OPERATION_RESTART", 0.6, r"\b(重启|restart|reboot)\b"),
    ("OPERATION_MONITOR", 0.6, r"\b(监控|monitor|monitoring|观察)\b"),
    ("OPERATION_ANALYZE", 0.6, r"\b(分析|analyze|analysis|诊断|diagnosis)\b"),
    ("OPERATION_FIX", 0.6, r"\b(修复|fix|repair|解决|solve)\b"),
]

# ---------------------------------------------------------------- fixed values: graph seeds
SEED_ENTITIES = {
    "SERVICE": [
        "service-a", "service-b", "service-c", "service-d", "service-e",
        "api-gateway", "user-service", "order-service", "payment-service",
        "notification-service", "auth-service", "web-server",
    ],
    "TECHNOLOGY": [
        "kubernetes", "docker", "mysql", "redis", "nginx", "prometheus",
        "grafana", "elasticsearch", "kafka", "rabbitmq", "mongodb",
    ],
    "HOST": ["d1-app-01", "d1-app-02", "d1-db-01", "d2-app-01", "d2-app-02", "d2-db-01", "lb-01", "lb-02"],
    "COMPONENT": ["load-balancer", "database", "cache", "message-queue", "monitoring", "logging", "security"],
}
SEED_RELATIONS = [
    ("service-a", "SERVICE", "d1-app-01", "HOST", "DEPLOYED_ON"),
    ("service-b", "SERVICE", "d1-app-02", "HOST", "DEPLOYED_ON"),
    ("service-c", "SERVICE", "d2-app-01", "HOST", "DEPLOYED_ON"),
    ("api-gateway", "SERVICE", "service-a", "SERVICE", "DEPENDS_ON"),
    ("api-gateway", "SERVICE", "service-b", "SERVICE", "DEPENDS_ON"),
    ("service-a", "SERVICE", "mysql", "TECHNOLOGY", "USES"),
    ("service-b", "SERVICE", "redis", "TECHNOLOGY", "USES"),
    ("prometheus", "TECHNOLOGY", "service-a", "SERVICE", "MONITORS"),
    ("prometheus", "TECHNOLOGY", "service-b", "SERVICE", "MONITORS"),
    ("grafana", "TECHNOLOGY", "prometheus", "TECHNOLOGY", "DEPENDS_ON"),
]
SEED_TOPOLOGY_EDGES = [
    ("service-a", "service-b", "ROUTES_TO"),
    ("service-a", "service-c", "ROUTES_TO"),
    ("service-b", "service-d1", "CALLS"),
    ("service-b", "service-d2", "CALLS"),
    ("service-b", "service-d3", "CALLS"),
    ("service-c", "service-f", "CALLS"),
    ("service-d1", "mysql-primary", "CONNECTS_TO"),
    ("service-d2", "mysql-primary", "CONNECTS_TO"),
    ("service-d3", "mysql-primary", "CONNECTS_TO"),
    ("service-f", "postgresql-secondary", "CONNECTS_TO"),
    ("service-a", "host-east-1", "DEPLOYED_ON"),
    ("service-b", "host-east-1", "DEPLOYED_ON"),
    ("service-c", "host-east-2", "DEPLOYED_ON"),
    ("service-d1", "host-east-2", "DEPLOYED_ON"),
    ("service-d2", "host-east-2", "DEPLOYED_ON"),
    ("service-d3", "host-east-2", "DEPLOYED_ON"),
    ("mysql-primary", "host-east-3", "DEPLOYED_ON"),
    ("service-f", "host-west-1", "DEPLOYED_ON"),
    ("postgresql-secondary", "host-west-1", "DEPLOYED_ON"),
]
SEED_TOPOLOGY_NODES = [
    ("service-a", "Service"), ("service-b", "Service"), ("service-c", "Service"), ("service-d1", "Service"),
    ("service-d2", "Service"), ("service-d3", "Service"), ("service-f", "Service"),
    ("mysql-primary", "Database"), ("postgresql-secondary", "Database"),
    ("host-east-1", "Host"), ("host-east-2", "Host"), ("host-east-3", "Host"), ("host-west-1", "Host"),
    ("DC-East", "DataCenter"), ("DC-West", "DataCenter"),
]
HOST_DATACENTER = [
    ("host-east-1", "DC-East"), ("host-east-2", "DC-East"), ("host-east-3", "DC-East"), ("host-west-1", "DC-West"),
]

# ---------------------------------------------------------------- fixed values: tasks, metrics, quality, privacy
STAGE_WEIGHTS = {
    "ner_extraction": 0.1, "hybrid_search": 0.3, "topology_query": 0.2,
    "agent_reasoning": 0.3, "result_formatting": 0.1,
}
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
QUALITY_WEIGHTS = {"completeness": 0.3, "accuracy": 0.25, "consistency": 0.2, "timeliness": 0.15, "relevance": 0.1}
MIN_CONTENT, MAX_CONTENT = 10, 100000
# data type, active days, archive days, deletion days
RETENTION = [
    ("chat_messages", 90, 365, 2555), ("task_executions", 30, 365, 2555), ("log_entries", 30, 180, 1095),
    ("knowledge_documents", None, None, None),
]
SENSITIVE_PATTERNS = {
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "phone_number": r"\b\d{3}[-\.\s]?\d{3}[-\.\s]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "password": r'password["\s]*[:=]["\s]*([^\s"]+)',
    "api_key": r'(?:api[_-]?key|access[_-]?token)["\s]*[:=]["\s]*([^\s"]+)',
    "ssh_key": r"ssh-(?:rsa|dss|ecdsa) [A-Za-z0-9+/]+[=]{0,2}",
    "jwt_token": r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
}
SANITIZE_PATTERNS = [
    ("password", r'password["\s]*[:=]["\s]*([^\s"]+)'),
    ("api_key", r'api[_-]?key["\s]*[:=]["\s]*([^\s"]+)'),
    ("token", r'token["\s]*[:=]["\s]*([^\s"]+)'),
    ("secret", r'secret["\s]*[:=]["\s]*([^\s"]+)'),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
]
QUALITY_THRESHOLDS = {
    "completeness_rate": 0.95, "accuracy_rate": 0.90, "timeliness_score": 0.85, "consistency_score": 0.95,
}
RETRAIN_TRIGGERS = [
    ("performance_degradation", 0.05, "high"), ("data_drift", 0.3, "medium"),
    ("knowledge_update", 0.2, "low"), ("scheduled_refresh", 180.0, "medium"),
]
