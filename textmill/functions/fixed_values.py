"""Texts, tables and numbers that results depend on."""

# Class names of the benchmark tables, in class-id order.
NLI_CLASSES = ["entailment", "contradiction", "neutral"]
KORNLI_CLASSES = ["entailment", "neutral", "contradiction"]
STS_GENRES = ["main-news", "main-captions", "main-forum", "main-forums"]
STS_FILES = [
    "images", "MSRpar", "MSRvid", "headlines", "deft-forum", "deft-news", "track5.en-en", "answers-forums", "answer-answer",
]
STS_YEARS = ["2017", "2016", "2013", "2012train", "2014", "2015", "2012test"]
TOPIC_CLASSES = ["IT과학", "경제", "사회", "생활문화", "세계", "스포츠", "정치"]
NER_CLASSES = [
    "O", "B-PS", "I-PS", "B-LC", "I-LC", "B-OG", "I-OG",
    "B-DT", "I-DT", "B-TI", "I-TI", "B-QT", "I-QT",
]

# Dependency relation labels, in class-id order.
DEPENDENCY_LABELS = [
    "NP", "NP_AJT", "VP", "NP_SBJ", "VP_MOD", "NP_OBJ", "AP", "NP_CNJ", "NP_MOD", "VNP",
    "DP", "VP_AJT", "VNP_MOD", "NP_CMP", "VP_SBJ", "VP_CMP", "VP_OBJ", "VNP_CMP", "AP_MOD", "X_AJT",
    "VP_CNJ", "VNP_AJT", "IP", "X", "X_SBJ", "VNP_OBJ", "VNP_SBJ", "X_OBJ", "AP_AJT", "L",
    "X_MOD", "X_CNJ", "VNP_CNJ", "X_CMP", "AP_CMP", "AP_SBJ", "R", "NP_SVJ",
]
DEPENDENCY_BAD = -2
DEPENDENCY_RARE = -3
DEPENDENCY_RARE_FROM = 15

# Target texts of the classification tasks.
SENTIMENT_TARGETS = {0: "positive", 1: "negative"}
NLI_TARGETS = {"entailment": "함의", "neutral": "중립", "contradiction": "모순"}
TOPIC_TARGETS = dict(enumerate(TOPIC_CLASSES))
PARAPHRASE_TARGETS = {0: "different", 1: "paraphrase"}

# Prompt templates. `{{ name }}` marks a variable.
SENTIMENT_INPUT = "nsmc sentiment classification: {{ input }}"
MULTITASK_INPUT = "Multitask classification:\n\n{{ input }}"
LABEL_ONLY = "{{ label }}"
DEFAULT_INPUT = "아래 문장에서 나타나는 감정을 '긍정' 또는 '부정'으로 분류하시오:\n\n{{ input }}"
DEFAULT_LABEL = "(긍정/부정) => {{ label }}"
NLI_INPUT = "NLI, 전제: {{ premise }}\n가설: {{ hypothesis }}\n"
TOPIC_INPUT = "KLUE YNAT task: {{ title }}\n"
MRC_INPUT = (
    "task: MRC, 지문을 읽고 질문에 답을 할 수 없다면 '[알 수 없음]'을 출력한다.\n\n"
    "### 질문\n{{ question }}\n\n### 지문\n{{ context }}\n"
)
NER_INPUT = "task: NER\n\n### 입력\n{{ sentence }}\n"
DEPENDENCY_INPUT = "task: Dependency Parsing\n\nInput: {{ sentence }}\nLemmas: {{ ma_out }}"
QA_INPUT = "task: MRC\n\nquestion: {{ question }}\n\ncontext: {{ context }}\n"
PARAPHRASE_INPUT = "paraphrase detection task:\n\nsentence-1: {{ sentence1 }}\nsentence-2: {{ sentence2 }}\n"
TITLE_CONTENT_INPUT = "#TITLE {{ title }}\n#CONTENT {{ content }}"

# Deliberation targets of the reading task.
UNKNOWN_ANSWER = "[알 수 없음]"
OUTPUT_PREFIX = "출력: "
CORRECT_MARK = "정답임"
WRONG_MARK = "정답이 아님"
NEW_ANSWER_MARK = ", 새 정답: "
UNANSWERABLE_PLAIN_ABOVE = 20
CORRUPT_BELOW = 3
CORRUPT_DIGIT_ONE_IN = 10
WITHHOLD_BELOW = 23
HANGUL_FIRST, HANGUL_END = 0xAC00, 0xD7AF

# Byte vocabulary: pad 0, end of sequence 1, unknown 2, byte b at b + 3, sentinel n at 259 + n.
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
BYTE_OFFSET, FIRST_SENTINEL_ID, VOCABULARY_SIZE = 3, 259, 384

# Span masking.
CONTEXT_MAX_BYTES = 1024
MASK_VARIANTS = 2

# Seeds of the sampling operators.
TEXT_TEST_SEED, TEXT_VALID_SEED = 592821, 395810
JSON_TEST_SEED, JSON_VALID_SEED = 59282, 39581
REBALANCE_SEED = 99
CLASSIFIER_SPLIT_SEED, CLASSIFIER_SAMPLE_SEED = 123456, 76543

# Characters that answer normalisation replaces by a space or deletes.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTE_CHARACTERS = "'\"《》<>〈〉()‘’"
# What becomes a space in the reading-task normalisation: a quote-like character with the four after it.
READING_QUOTE_PATTERN = "['\"《》<>〈〉]\\(\\)‘’"

# Characters that may stand before a word when tags are put back into a sentence.
TAG_BOUNDARY_CHARACTERS = [
    " ", "'", '"', "(", "[", ",", ".", ")", "·", "+", "비", "즈", "면", "별", "리", "말",
    "]", ">", "<", "&", "-", "→",
]
