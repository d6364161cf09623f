"""Closed vocabularies, weights and keyword tables. They decide results, so they stay as they are."""

OBSERVATION_STATUSES = ("candidate", "fast_stored", "confirmed", "auto_confirmed", "rejected", "deprecated", "disputed", "orphan", "superseded")
#: Not live for writes and cross-workspace counts.
DEAD = ("superseded", "rejected", "deprecated")
#: Live for offline maintenance and linking.
STRICT = ("candidate", "fast_stored", "confirmed", "auto_confirmed")
#: Concept statuses that may be recalled.
RECALLABLE = ("active", "disputed")

NEGATIONS = (("has", "not_has"), ("depends_on", "not_depends_on"), ("related_to", "not_related_to"))
PREDICATES = {
    "has": ("has", "have", "has_field", "contains", "contain", "includes", "include", "owns", "possesses"),
    "not_has": ("not_has", "not_have", "not_has_field", "lacks", "lacks_field", "missing", "does_not_have", "doesnt_have", "does_not_contain", "doesnt_contain", "excludes", "without"),
    "depends_on": ("depends_on", "depend_on", "depends", "depends_upon", "requires", "uses", "dependency"),
    "not_depends_on": ("not_depends_on", "not_depend_on", "does_not_depend_on", "doesnt_depend_on", "not_depends"),
    "related_to": ("related_to", "relate_to", "related", "possibly_related", "possibly_related_to", "may_relate_to", "associated_with", "associates_with", "links_to", "linked_to", "references"),
    "not_related_to": ("not_related_to", "not_relate_to", "unrelated", "not_associated", "not_associated_with"),
    "causes": ("causes", "cause", "is_root_cause", "root_cause", "root_cause_of", "leads_to", "lead_to", "triggers", "results_in"),
}

#: Evidence type: added alpha, added beta.
EVIDENCE = {
    "user_confirmation": (2.0, 0.0),
    "file_evidence": (1.5, 0.0),
    "repeated_occurrence": (1.0, 0.0),
    "cross_session_3_plus": (2.0, 0.0),
    "cross_session_2": (1.0, 0.0),
    "human_review_confirm": (2.0, 0.0),
    "recall_not_corrected": (0.3, 0.0),
    "user_negation": (0.0, 3.0),
    "conflicting_evidence": (0.0, 2.0),
    "recall_corrected": (0.0, 1.5),
    "internal_conflict": (0.0, 1.0),
    "assistant_speculation": (0.0, 0.0),
}
#: Source type: evidence that a row of it starts with.
FIRST_EVIDENCE = {"file_evidence": "file_evidence", "user_confirm": "user_confirmation", "user_negation": "user_negation", "assistant_guess": "assistant_speculation"}
SOURCE_FACTOR = {"file_evidence": 1.25, "user_confirm": 1.15, "user_negation": 1.15, "user_message": 1.0, "assistant_guess": 0.5}

#: Feedback type: added alpha, added beta.
FEEDBACK = {"confirm": (2.0, 0.0), "negate": (0.0, 3.0), "supplement": (0.5, 0.0), "correct": (0.0, 2.0), "preference": (1.0, 0.0), "general": (0.0, 0.0)}

#: The first table with a keyword in the text gives the class.
FEEDBACK_WORDS = (
    ("negate", ("不对", "错了", "不是", "不正确", "no", "wrong", "不是这个")),
    ("confirm", ("对", "没错", "正确", "是的", "yes", "right", "就是这个")),
    ("supplement", ("还有", "补充", "另外", "加上", "also", "and")),
    ("correct", ("应该是", "其实是", "实际上是", "actually", "should be")),
    ("preference", ("偏好", "以后都", "我喜欢", "prefer", "i like", "always use")),
)
PERSISTENCE_WORDS = (
    ("task_temporary", ("这次", "本次", "先这样", "临时", "just this once", "for this task", "this time only", "暂时", "这回", "就这一次")),
    ("long_term", ("以后", "一直", "永远", "默认", "以后都", "always", "from now on", "going forward", "by default", "长期", "记住")),
    ("scenario_specific", ("在这个项目", "本项目", "该仓库", "这个仓库", "in this repo", "in this project", "for this codebase", "场景")),
)
INTENT_WORDS = (
    ("continue_investigation", ("继续看", "接着查", "还差", "接下来", "continue", "resume", "next")),
    ("verify_fact", ("确认", "是不是", "有没有", "verify", "confirm", "check", "whether")),
    ("correct_mistake", ("不对", "错了", "不是这个", "其实是", "wrong", "incorrect", "actually")),
    ("add_knowledge", ("补充", "还有", "另外", "加上", "add", "also", "note")),
    ("review_history", ("之前", "上次", "历史", "原来", "previous", "history", "last time")),
)
CORRECTION_CUES = ("不对", "错了", "不是这样", "应该是", "你搞错", "搞错了", "wrong", "that's incorrect", "not quite", "actually", "更正", "纠正")
#: Keys that name no entity in a query.
QUERY_STOPWORDS = ("the", "and", "for", "with", "that", "this", "what", "when", "where", "why", "how", "确认", "是不是", "有没有", "之前", "上次", "历史")
#: Keys that name no entity in feedback.
FEEDBACK_STOPWORDS = ("还有", "补充", "另外", "加上", "also", "and", "the", "for", "with", "this", "that", "还要", "以及")
#: Intent: percent of the budget for preferences, facts, rejected hypotheses, task state and entities.
INTENT_BUDGETS = {
    "continue_investigation": (10, 30, 10, 35, 15),
    "verify_fact": (10, 45, 20, 10, 15),
    "correct_mistake": (10, 30, 35, 10, 15),
    "add_knowledge": (15, 30, 10, 25, 20),
    "review_history": (15, 40, 15, 15, 15),
    "general_query": (15, 40, 15, 15, 15),
}
#: Source type of an observation: how far its extraction is trusted. Unknown types count as assistant_guess.
TRUST = {"file_evidence": 0.9, "user_confirm": 0.85, "user_negation": 0.8, "user_message": 0.7, "assistant_guess": 0.3}
#: Endings that the aggressive entity key drops, in the order in which they are tried.
PASCAL_ENDINGS = ("Impl", "Class", "Type", "Model", "Table", "Entity", "Info", "Data", "Object", "Service", "Manager", "Handler", "Config")
JOINED_ENDINGS = ("_table", "_tbl", "_entity", "_model", "_class", "_type", "_info", "_data", "_config", "_obj", "_mgr", "_manager", "_service", "_handler")
BARE_ENDINGS = ("service", "handler", "manager", "config", "entity", "model", "class", "table", "type", "info", "data", "object", "impl")
#: Statuses of concepts, candidates and timeline entries; scopes in order; relation types, and those whose ends have an order.
CONCEPT_STATUSES = ("candidate", "active", "labile", "deprecated", "disputed")
CANDIDATE_STATUSES = ("candidate", "promoted", "rejected", "superseded")
TIMELINE_STATUSES = ("active", "expired", "superseded")
SCOPES = ("project", "domain", "global")
RELATION_TYPES = ("shared_entity", "shared_session", "embedding_similarity", "temporal")
DIRECTED = ("temporal",)
MEMORY_ACTIONS = ("add", "reinforce", "update", "merge", "skip")
