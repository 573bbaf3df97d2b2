"""Limits, thresholds, weights and word lists of the knowledge-graph operators."""

from __future__ import annotations

from dataclasses import dataclass

# Characters and words of the mention filters.
NUMERALS = "一二三四五六七八九十百千万零〇0１２３４５６７８９0123456789"
LETTERS = "\\u4e00-\\u9fffA-Za-z0-9"
STOP_WORDS = (
    "行为", "规定", "情况", "方面", "问题", "过程", "内容", "方式", "结果", "因素", "原则", "要求",
    "对象", "责任", "制度", "标准", "措施", "情形", "目的", "性质", "概念", "关系", "依据", "条件",
    "范围", "程度", "方法", "意见", "决定", "通知", "公告", "材料", "证据", "事实", "理由", "结论",
)
GENERIC_ENDS = ("方面", "问题", "情况", "过程", "内容", "方式", "结果", "因素", "原则", "要求", "制度", "关系", "标准", "措施", "情形")
OUTER_MARKS = "《》「」【】[]()（）\"'“”‘’"
LIST_MARKS = "、，,；;/／"
UNSPLIT = ("罪刑法定原则",)
BOOK_STOPS = ("决定", "修正案")
BASE_RELATIONS = ("defines", "includes", "part_of", "causes", "applies_to", "related_to")
TRUTH_RELATIONS = ("defines", "includes", "part_of", "causes", "applies_to", "punishes", "related_to")
GENERIC_RELATIONS = ("related_to", "related", "relation", "关联", "相关")
BLOOM_LEVELS = {"B1": "Remember", "B2": "Understand", "B3": "Apply", "B4": "Analyze", "B5": "Evaluate", "B6": "Create"}
# Names under which a column may come, in order of preference.
NODE_COLUMNS = {"id": ("node_id", "id", "entity_id", "uid"), "name": ("name", "label", "text", "title", "entity_name"), "alias": ("aliases", "alias", "synonyms")}
EDGE_COLUMNS = {"src": ("src_id", "source_id", "source", "head_id", "head", "subj_id", "subj"), "dst": ("dst_id", "target_id", "target", "tail_id", "tail", "obj_id", "obj"), "rel": ("relation_type", "relation", "rel", "predicate", "edge_type")}


@dataclass(frozen=True)
class Config:
    """Parameters by operator; the defaults are those of the current generation of the pipeline."""

    mention_min: int = 2
    mention_max: int = 20
    generic_max: int = 6
    entities_kept: int = 8
    truth_candidates: int = 12
    truth_kept: int = 6
    pairs_kept: int = 20
    mentions_used: int = 10
    relation_candidates: int = 10
    relations_kept: int = 6
    truth_batch: int = 10
    truth_mentions: int = 10
    batch_sentences: int = 8
    batch_relations: int = 120
    entity_confidence: float = 0.85
    relation_confidence: float = 0.80
    truth_confidence: float = 0.95
    ner_least_score: float = 0.50
    similar: float = 0.88
    facts_a_chunk: int = 5
    questions_a_chunk: int = 3
    questions_most: int = 50
    revise_below: float = 85.0
    judge_default: int = 60
    feedback_edges: int = 1
    feedback_nodes: int = 2
    safety_ratio: float = 0.30
    safety_most: int = 200
    drawn_edges: int = 1500


CONFIG = Config()
