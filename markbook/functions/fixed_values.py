"""Fixed values.

Everything in this file is a value that has to equal the one used by the published evaluation
recipe for results to agree: word lists, template texts, dataset names, markers and constants.
"""

# Unit words removed from answers, in the order they are tried.  They are regex texts: the dot
# in "p . m" stands for any character.  The plural forms follow by rule (see UNIT_PATTERNS).
UNIT_WORDS = [
    "east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile",
    "q .", "monkey", "prime", "ratio", "profit of rs", "rd", "o", "gm", "p . m", "lb",
    "tile", "per", "dm", "lt", "gain", "ab", "way", "west", "a .", "b .",
    "c .", "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change",
    "men", "soldier", "pie", "bc", "excess", "st", "inches", "noon", "percent", "by",
    "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq", "mark",
    "l", "toy", "coin", "sq . m", "gallon", "° f", "profit", "minw", "yr", "women",
    "feet", "am", "pm", "hr", "cu cm", "square", "v â € ™", "are", "rupee", "rounds",
    "cubic", "cc", "mtr", "s", "ohm", "number", "kmph", "day", "hour", "minute",
    "min", "second", "man", "woman", "sec", "cube", "mt", "sq inch", "mp", "∏ cm ³",
    "hectare", "more", "sec", "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g",
    "month", "km", "m", "cm", "mm", "apple", "liter", "loss", "yard", "pure",
    "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .", "metre",
    "meter", "inch",
]
UNIT_PATTERNS = UNIT_WORDS + [word + "s" for word in UNIT_WORDS]

# Number words and their values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
    "million": 1000000, "billion": 1000000000,
}

# Datasets that need their own treatment.
CHOICE_DATASETS = ["mmlu_stem", "sat_math", "aqua", "gaokao2023", "gpqa"]
LAST_LETTER_DATASETS = ["sat_math", "aqua", "gpqa"]
UNSTRIPPED_DATASETS = ["carp_en", "minerva_math"]
WORKED_SOLUTION_DATASETS = ["math", "minerva_math", "math500"]
PLAIN_ANSWER_DATASETS = [
    "aime24", "amc23", "aimo2", "cmath", "gaokao2024_I", "gaokao2024_II", "imo2024",
    "AI-MO/aimo-validation-aime",
]
DOLLAR_ANSWER_DATASETS = ["gaokao2023en", "college_math", "gaokao_math_cloze"]
CHOICE_OR_ANSWER_DATASETS = ["gaokao2024_mix", "cn_middle_school"]
ADAPTIVE_SHOT_DATASETS = [
    "gaokao2024_I", "gaokao2024_II", "gaokao_math_qa", "gaokao2024_mix", "cn_middle_school",
]
CHOICE_LETTERS = ["A", "B", "C", "D", "E"]

# Science subjects kept from the large choice set.
STEM_SUBJECTS = [
    "abstract_algebra", "astronomy", "college_biology", "college_chemistry",
    "college_computer_science", "college_mathematics", "college_physics", "computer_security",
    "conceptual_physics", "electrical_engineering", "elementary_mathematics",
    "high_school_biology", "high_school_chemistry", "high_school_computer_science",
    "high_school_mathematics", "high_school_physics", "high_school_statistics",
    "machine_learning",
]
WORD_PROBLEM_PARTS = ["singleeq", "singleop", "addsub", "multiarith"]

# Which demo family serves a dataset that has none of its own.
DEMO_FAMILY = {
    "gsm_hard": "gsm8k", "svamp": "gsm8k", "tabmwp": "gsm8k", "asdiv": "gsm8k",
    "mawps": "gsm8k",
    "math_oai": "math", "hungarian_exam": "math", "math-oai": "math", "aime24": "math",
    "amc23": "math", "aimo2": "math",
    "sat_math": "mmlu_stem",
    "gaokao2024_I": "gaokao", "gaokao2024_II": "gaokao", "gaokao_math_qa": "gaokao",
    "gaokao2024_mix": "gaokao", "cn_middle_school": "gaokao",
}

# Optional sample fields carried along when a question set has them.
CARRIED_FIELDS = [
    "level", "type", "unit", "solution_type", "choices", "solution", "ques_type", "ans_type",
    "answer_type", "dataset", "subfield", "filed", "theorem", "answer",
]

# Prompt templates: name -> (question part, answer part, splitter between demos).
# One name has no splitter of its own; the empty text stands in for it.
_BOXED = "Please reason step by step, and put your final answer within \\boxed{{}}."
_CHAT_TAIL = "<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n"
PROMPT_TEMPLATES = {
    "direct": ("Question: {input}\nAnswer: ", "{output}", "\n\n"),
    "cot": ("Question: {input}\nAnswer: ", "{output}", "\n\n\n"),
    "pal": ("Question: {input}\n\n", "{output}", "\n---\n"),
    "tool-integrated": ("Question: {input}\n\nSolution:\n", "{output}", "\n---\n"),
    "self-instruct": ("<|user|>\n{input}\n<|assistant|>\n", "{output}", "\n"),
    "tora": ("<|user|>\n{input}\n<|assistant|>\n", "{output}", "\n"),
    "wizard_zs": (
        "### Instruction:\n{input}\n\n### Response: Let's think step by step.", "{output}", "\n\n\n"),
    "platypus_fs": ("### Instruction:\n{input}\n\n### Response:\n", "{output}", "\n\n\n"),
    "deepseek-math": ("User: {input}\n" + _BOXED + "\n\nAssistant:", "{output}", "\n\n\n"),
    "kpmath": (
        "User: Please reason step by step and put your final answer at the end "
        'with "The answer is: ".\n\n{input}\n\nAssistant:', "{output}", ""),
    "jiuzhang": ("## Question\n{input}\n\n## Solution\n", "{output}", "\n\n\n"),
    "jiuzhang_tora": ("## Question\n{input}\n\n## Code Solution\n", "{output}", "\n\n\n"),
    "jiuzhang_nl": (
        "## Question\n{input}\n\n## Natural Language Solution\n", "{output}", "\n\n\n"),
    "mmiqc": (
        "Please solve the following problem and put your answer at the end with "
        '"The answer is: ".\n\n{input}\n\n', "{output}", "\n\n\n"),
    "abel": (
        "Question:\n{input}\nAnswer:\nLet's think step by step.\n", "{output}", "\n\n"),
    "shepherd": ("{input}\n", "{output}", "\n\n\n"),
    "qwen-boxed": (
        "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n{input}\n"
        + _BOXED + "<|im_end|>\n<|im_start|>assistant\n", "{output}", "\n\n"),
    "qwen25-math-cot": (
        "<|im_start|>system\n" + _BOXED + "<|im_end|>\n" + _CHAT_TAIL, "{output}", "\n\n"),
    "qwen25-math-cot-en": (
        "<|im_start|>system\n" + _BOXED + " You must answer in English.<|im_end|>\n" + _CHAT_TAIL,
        "{output}", "\n\n"),
    "mathstral": ("{input}\n" + _BOXED, "{output}", "\n\n"),
    "internlm-math-fs": ("Question:{input}\nAnswer:", "{output}", "\n"),
    "internlm-math-chat": (_CHAT_TAIL, "{output}", "\n\n"),
    "mistral": ("[INST] {input}[/INST]", "{output}", "\n\n"),
    "numina": ("### Problem: {input}\n### Solution:", " {output}", "\n\n"),
    "llama3": (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n" + _BOXED
        + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{input}<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\n", "{output}", "\n\n"),
    "deepseek-r1": (
        "<｜begin▁of▁sentence｜><｜User｜>{input}\n" + _BOXED + "<｜Assistant｜>", "{output}", "\n\n"),
    "deepseek-r1-system": (
        "<｜begin▁of▁sentence｜>" + _BOXED + "<｜User｜>{input}<｜Assistant｜>", "{output}", "\n\n"),
}

# Texts wrapped around prompts.
THINKING_MODELS = ["qwen3", "openthinker"]
EMPTY_THINKING = "<think>\n\n</think>\n\n"
THINKING_END = "</think>"
THINKING_CLOSER = (
    "\nConsidering the limited time by the user, I have to give the solution based on the "
    "thinking directly now.\n</think>"
)
INSTRUCTION_WRAPPER = (
    "Below is an instruction that describes a task. Write a response that appropriately "
    "completes the request.\n\n### Instruction:\n",
    "\n\n### Response:\n",
)
# The text really holds a backspace character before "oxed", and that is part of the value.
CODE_GUIDELINES = (
    "Integrate step-by-step reasoning and Python code to solve math problems using the "
    "following guidelines:\n\n"
    "- Analyze the question and write functions to solve the problem; the function should not "
    "take any arguments.\n"
    "- Present the final result in LaTeX using a `\boxed{}` without any units.\n"
    "- Utilize the `pi` symbol and `Rational`` from Sympy for $\\pi$ and fractions, and simplify "
    "all fractions and square roots without converting them to decimal values.\n\n"
    "Here are some examples you may refer to:\n\n---\n\n"
)

# Words that end a completion.
BASE_STOP_WORDS = ["</s>", "<|im_end|>", "<|endoftext|>"]

# Key words that mark a failed program run.
FAILURE_WORDS = ["error", "exception", "no algorithms", "cannot", "nan", "..."]

# Phrases that introduce an answer.
ANSWER_TRIGGERS = ["choice is", "answer is"]

# Constants.
REL_TOL = 1e-4
ABS_TOL = 1e-3
IGNORED_LABEL = -100
PREVIEW_CHARS = 200
TRUNCATE_CHARS = 400
CORPUS_HEAD_DOCS = 1100
CORPUS_HEAD_WINDOWS = 256

# Marks around a turn in chat markup.
CHAT_START = "<|im_start|>"
CHAT_END = "<|im_end|>"
