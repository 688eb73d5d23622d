"""Tool names, providers and agents across runtimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical names of the tools of each runtime.
TOOL_ALIASES = {
    "opencode": {
        "bash": "Bash",
        "read": "Read",
        "edit": "Edit",
        "write": "Write",
        "grep": "Grep",
        "glob": "Glob",
        "todowrite": "TodoWrite",
        "skill_mcp": "Skill",
        "skill": "Skill",
        "task": "Task",
        "question": "Question",
        "websearch": "WebSearch",
        "webfetch": "WebFetch",
        "lsp_diagnostics": "LSPDiagnostics",
        "background_output": "BackgroundOutput",
    },
    "continue": {
        "read": "Read",
        "readfile": "Read",
        "edit": "Edit",
        "editfile": "Edit",
        "write": "Write",
        "create": "Write",
        "bash": "Bash",
        "terminal": "Bash",
        "command": "Bash",
        "run": "Bash",
        "search": "Grep",
        "grep": "Grep",
        "glob": "Glob",
        "file_search": "Grep",
        "web": "WebFetch",
        "web_fetch": "WebFetch",
        "http": "WebFetch",
        "python": "Bash",
        "ipython": "Bash",
    },
    "copilot": {
        "read_file": "Read",
        "read": "Read",
        "view": "Read",
        "write_file": "Write",
        "write": "Write",
        "create_file": "Write",
        "edit_file": "Edit",
        "edit": "Edit",
        "run_in_terminal": "Bash",
        "run_terminal": "Bash",
        "bash": "Bash",
        "command": "Bash",
        "terminal": "Bash",
        "search": "Grep",
        "grep": "Grep",
        "glob": "Glob",
        "file_search": "Grep",
        "web_fetch": "WebFetch",
        "fetch_webpage": "WebFetch",
        "fetch": "WebFetch",
        "web_search": "WebSearch",
        "simple_browser": "WebFetch",
        "install_extension": "Extension",
        "open": "Read",
        "list": "Glob",
        "list_dir": "Glob",
        "status": "Bash",
        "diff": "Read",
        "apply_diff": "Edit",
    },
    "codex": {
        "bash": "Bash",
        "shell": "Bash",
        "command": "Bash",
        "run": "Bash",
        "exec_command": "Bash",
        "read": "Read",
        "read_file": "Read",
        "view": "Read",
        "write": "Write",
        "write_file": "Write",
        "create": "Write",
        "edit": "Edit",
        "edit_file": "Edit",
        "apply_patch": "Edit",
        "search": "Grep",
        "grep": "Grep",
        "glob": "Glob",
        "web_fetch": "WebFetch",
        "web_search": "WebSearch",
        "fetch": "WebFetch",
        "web": "WebFetch",
        "think": "Reasoning",
        "reason": "Reasoning",
    },
}

# Fixed values: (how, text, provider) tried in order on the lower-case model name.
PROVIDER_RULES = {
    "prefix": (
        ("prefix", "claude", "anthropic"),
        ("prefix", "deepseek", "deepseek"),
        ("prefix", "ark-", "bytedance"),
        ("prefix", "doubao", "bytedance"),
        ("prefix", "gpt-", "openai"),
        ("prefix", "o1", "openai"),
        ("prefix", "o3", "openai"),
        ("prefix", "minimax", "minimax"),
    ),
    "substring": (
        ("part", "claude", "anthropic"),
        ("part", "anthropic", "anthropic"),
        ("part", "gpt", "openai"),
        ("part", "openai", "openai"),
        ("part", "o1", "openai"),
        ("part", "o3", "openai"),
        ("part", "o4", "openai"),
        ("part", "deepseek", "deepseek"),
        ("part", "doubao", "bytedance"),
        ("part", "seed", "bytedance"),
        ("part", "gemini", "google"),
        ("part", "llama", "meta"),
        ("part", "meta", "meta"),
        ("part", "mistral", "mistral"),
        ("part", "qwen", "alibaba"),
    ),
    "route": (
        ("part", "claude", "anthropic"),
        ("part", "deepseek", "deepseek"),
        ("part", "gpt", "openai"),
        ("prefix", "o1", "openai"),
        ("prefix", "o3", "openai"),
        ("prefix", "o4", "openai"),
        ("part", "gemini", "google"),
        ("part", "qwen", "alibaba"),
        ("part", "glm", "zhipu"),
        ("part", "kimi", "moonshot"),
        ("part", "moonshot", "moonshot"),
        ("part", "doubao", "bytedance"),
        ("part", "seed", "bytedance"),
        ("part", "minimax", "minimax"),
        ("part", "mistral", "mistral"),
        ("part", "llama", "meta"),
    ),
}

DIRECT_MODELS = (
    "deepseek-v4-pro",
    "deepseek-chat",
    "deepseek-v4-flash",
    "ark-code-latest",
    "doubao-seed-2.0-pro",
)
AGENT_PROVIDERS = {"opencode": "bytedance", "claude-code": "deepseek", "codex": "openai"}


def canonical_tool(name: Column, runtime: str) -> Column:
    """Canonical tool name of one runtime; unknown names pass through."""
    table = F.create_map(*[F.lit(x) for pair in TOOL_ALIASES[runtime].items() for x in pair])
    key = name
    if runtime != "opencode":
        key = F.lower(F.trim(name))
    if runtime in ("continue", "codex"):
        key = F.translate(key, " -", "__")
    return F.coalesce(F.element_at(table, key), name)


def normalize_tool(events: DataFrame, runtime: str) -> DataFrame:
    return events.withColumn("tool_name", canonical_tool(F.col("tool_name"), runtime))


def infer_provider(model: Column, rules: str = "prefix", default: Column | None = None) -> Column:
    """Provider of a model name by one of the rule lists, else ``default`` (or blank)."""
    m = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for how, text, provider in PROVIDER_RULES[rules]:
        cond = m.startswith(text) if how == "prefix" else m.contains(text)
        out = F.when(cond, provider) if out is None else out.when(cond, provider)
    return out.otherwise(F.lit("") if default is None else default)


def _guess_agent(session: Column, provider: Column, model: Column) -> Column:
    return (
        F.when(session.startswith("ses_"), "opencode")
        .when(session.startswith("aider_"), "aider")
        .when(session.startswith("019"), "codex")
        .when(provider == "openai", "codex")
        .when(provider == "opencode", "opencode")
        .when(provider == "anthropic", "claude-code")
        .when(model.contains("doubao") & (provider == ""), "opencode")
        .when(model.isin(*DIRECT_MODELS), "claude-code")
        .when(model.contains("minimax"), "opencode")
        .otherwise("claude-code")
    )


def session_attribution_guess(events: DataFrame) -> DataFrame:
    """Agent and provider of each session from its first event, id and model.

    A guessed ``claude-code`` gives way to the first agent any event names.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    named = F.nullif("agent", F.lit(""))
    first = events.groupBy("session_id").agg(
        F.min_by(F.struct("agent", "provider", "model"), "pos").alias("f"),
        F.min_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("_named"),
    )
    flat = first.select("session_id", "_named", "f.agent", "f.provider", "f.model")
    guess = F.when(text("agent") != "", text("agent")).otherwise(
        _guess_agent(F.col("session_id"), text("provider"), text("model"))
    )
    flat = flat.withColumn("_agent", guess)
    by_agent = F.create_map(*[F.lit(x) for pair in AGENT_PROVIDERS.items() for x in pair])
    provider = F.coalesce(
        F.nullif(text("provider"), F.lit("")),
        F.nullif(infer_provider(F.col("model"), "prefix"), F.lit("")),
        F.element_at(by_agent, F.col("_agent")),
        F.lit(""),
    )
    agent = F.when(F.col("_agent") == "claude-code", F.coalesce("_named", "_agent")).otherwise(
        F.col("_agent")
    )
    return flat.select("session_id", agent.alias("fill_agent"), provider.alias("fill_provider"))


def backfill(events: DataFrame) -> DataFrame:
    """Events with empty agent and provider filled per session; ``fixed`` marks changes."""
    df = events.join(session_attribution_guess(events), "session_id")
    no_agent = F.coalesce("agent", F.lit("")) == ""
    no_provider = F.coalesce("provider", F.lit("")) == ""
    return (
        df.withColumn(
            "fixed",
            (no_agent & (F.col("fill_agent") != "")) | (no_provider & (F.col("fill_provider") != "")),
        )
        .withColumn("agent", F.when(no_agent, F.col("fill_agent")).otherwise(F.col("agent")))
        .withColumn("provider", F.when(no_provider, F.nullif("fill_provider", F.lit(""))).otherwise(F.col("provider")))
        .drop("fill_agent", "fill_provider")
    )


def backfill_report(filled: DataFrame) -> DataFrame:
    return filled.groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_if("fixed").alias("fixed")
    )
