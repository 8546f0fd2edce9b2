"""Full and display names of models, methods and tasks."""

# Short model names and what they stand for.
MODEL_ALIASES: dict[str, str] = {
    "llama-3.2-1b": "meta-llama/Llama-3.2-1B-Instruct",
    "llama-3.2-1b-turbo": "meta-llama/Llama-3.2-1B-Instruct-Turbo",
    "llama-3.2-3b": "meta-llama/Llama-3.2-3B-Instruct",
    "llama-3.2-3b-turbo": "meta-llama/Llama-3.2-3B-Instruct-Turbo",
    "llama-3.2-11b": "meta-llama/Llama-3.2-11B-Vision-Instruct",
    "llama-3.2-90b": "meta-llama/Llama-3.2-90B-Vision-Instruct",
    "llama-3.2-90b-turbo": "meta-llama/Llama-3.2-90B-Vision-Instruct-Turbo",
    "qwen-2.5-1.5b": "Qwen/Qwen2.5-1.5B-Instruct",
    "qwen-2.5-3b": "Qwen/Qwen2.5-3B-Instruct",
    "qwen-2.5-7b": "Qwen/Qwen2.5-7B-Instruct",
    "qwen-2.5-14b": "Qwen/Qwen2.5-14B-Instruct",
    "qwen-3-1.7b": "Qwen/Qwen3-1.7B",
    "qwen-3-1.7b-thinking": "Qwen/Qwen3-1.7B-Thinking",
    "qwen-3-4b": "Qwen/Qwen3-4B",
    "qwen-3-4b-thinking": "Qwen/Qwen3-4B-Thinking",
    "qwen-3-8b": "Qwen/Qwen3-8B",
    "qwen-3-8b-thinking": "Qwen/Qwen3-8B-Thinking",
    "olmo-2-1b": "allenai/OLMo-2-0425-1B-Instruct",
    "olmo-2-7b": "allenai/OLMo-2-1124-7B-Instruct",
}

# Memory in GB by size, where it is not four times the size.
MODEL_MEMORY: dict[str, float] = {"7b": 30.0, "11b": 30.0}
DEFAULT_MEMORY = 12.0

# How reports name methods, tasks and model families.
METHODS: dict[str, str] = {
    "original": "Base Model", "base": "Append", "ft_ck": "FT-CK", "mello": "MeLLo", "append_t": "Append-T",
}
TASKS: dict[str, str] = {"grow": "WIKI", "code": "CODE", "math": "MATH"}
FAMILIES: dict[str, str] = {
    "llama-3.2-1b": "Llama-3.2 Series", "llama-3.2-3b": "Llama-3.2 Series", "llama-3.2-11b": "Llama-3.2 Series",
    "qwen-3-1.7b": "Qwen-3 Series", "qwen-3-4b": "Qwen-3 Series", "qwen-3-8b": "Qwen-3 Series",
    "gpt-4.1-mini": "GPT Series", "o4-mini": "GPT Series",
}

# How reports name models; the last two share a row of the tables.
MODELS: dict[str, str] = {
    "llama-3.2-1b": "Llama-3.2 \\textsubscript{(1B)}",
    "llama-3.2-3b": "Llama-3.2 \\textsubscript{(3B)}",
    "llama-3.2-11b": "Llama-3.2 \\textsubscript{(11B)}",
    "qwen-3-1.7b": "Qwen-3 \\textsubscript{(1.7B)}",
    "qwen-3-4b": "Qwen-3 \\textsubscript{(4B)}",
    "qwen-3-8b": "Qwen-3 \\textsubscript{(8B)}",
    "gpt-4.1-mini": "GPT-4.1-mini & o4-mini",
    "o4-mini": "GPT-4.1-mini & o4-mini",
}

# Fixed value: this model reasons by itself, so its plain runs are reported as Append-T.
THINKING_ONLY = "o4-mini"
