"""Reports over ranked candidates; all of them are small, so the driver writes them."""

from __future__ import annotations

import json

from ..functions import fixed as x

# Titles, lines and labels of the reports, here and in the functions below.
TITLES = {
    "constraint": "约束与红线 → AGENTS", "preference": "偏好 → AGENTS", "tooling": "工具习惯 → AGENTS", "workflow": "工作流 → skill / prompt",
    "other": "附录 A：未分类（strong）", "medium": "附录 B：覆盖不足（medium）", "template": "附录 C：模板展开文本",
}
DEST_TITLES = {"AGENTS": "写入 AGENTS 的规则", "skill": "做成 skill 的工作流", "prompt": "做成 prompt template 的指令", "notes": "记入 notes 的事实"}
NONE = "无"
NOTE = "- 依据中的编号对应 candidates.md；「簇合计」是依据簇的全部发言数与项目数（本地计算），簇内可能含与结论无关的变体，不等于支持该结论的次数"


def cell(text: str) -> str:
    return " ".join(text.split()).replace("|", "\\|")


def _variants(c: dict) -> str:
    if c["variant_count"] == 1:
        return ""
    listed = [f"{cell(v['text'])} ×{v['count']}" for v in c["variants"]]
    more = c["variant_count"] - len(listed)
    return " · ".join(listed + [f"另 {more} 种"] * (more > 0))


def _row(c: dict, section: str) -> str:
    if section == "template":
        return f"- #{c['number']} {cell(c['label'])}（{c['count']} 次 / {c['project_count']} 项目）"
    kind = [c["kind"], c["suggested_dest"]] if section == "medium" else []
    return "| " + " | ".join(map(str, [f"{c['number']}", cell(c["label"]), c["count"], c["project_count"], *kind, _variants(c)])) + " |"


def candidates_md(candidates: list[dict], summary: dict) -> str:
    s = summary
    out = [
        "# 资产候选\n",
        f"- 发言 {s['utterance_count']} → 句子 {s['phrase_count']} → 簇 {s['cluster_count']} → 候选 {s['candidate_count']}（strong {s['strong_count']}）",
        f"- 聚类：{s['cluster_backend']}；阈值：min-count {s['min_count']}，min-projects {s['min_projects']}",
        "- 句式中 ‹路径› / ‹数字› 为参数占位；变体列为簇内合并的不同写法及次数\n",
    ]
    for section in x.SECTIONS:
        rows = [_row(c, section) for c in candidates if c["section"] == section]
        head = ["#", "句式", "次数", "项目", *(["类型", "建议"] if section == "medium" else []), "变体"]
        table = [] if section == "template" or not rows else ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
        out.append("\n".join([f"## {TITLES[section]}（{len(rows)}）", "", *(table + rows or [NONE]), ""]))
    return "\n".join(out).rstrip() + "\n"


def candidates_json(candidates: list[dict], summary: dict) -> str:
    kept = [{k: v for k, v in c.items() if k != "section"} for c in candidates]
    return json.dumps({"summary": summary, "candidates": kept}, ensure_ascii=False, indent=2) + "\n"


def persona_md(candidates: list[dict], total: int, corrections: int, top: list[dict], projects: list[dict]) -> str:
    share = f"{100 * corrections / total:.1f}%" if total else "n/a"

    def listed(kinds: tuple[str, ...], confidence: str) -> str:
        rows = [f"- {c['label']} (count {c['count']}, projects {c['project_count']})" for c in candidates if c["kind"] in kinds and c["confidence"] == confidence]
        return "\n".join(rows[: x.ITEMS_SHOWN] or ["- None"])

    frequent = "\n".join([f"  - {cell(p['text'][:80])} (count {p['count']})" for p in top[: x.ITEMS_SHOWN]] or ["  - None"])
    parts = {
        "Collaboration style": f"- utterances after merge: {total}\n- correction / constraint share: {share} ({corrections})\n- most frequent corrections:\n{frequent}",
        "Red lines (strong constraints)": listed(("constraint",), "strong"),
        "Tooling and workflow habits (strong)": listed(("tooling", "workflow"), "strong"),
        "Preferences (strong)": listed(("preference",), "strong"),
        "Unstable patterns (frequent but narrow coverage)": listed(x.SECTIONS[:5], "medium"),
        "Project distribution": "\n".join(["| project | utterances |", "|---|---|", *(f"| {cell(p['cwd'])} | {p['n']} |" for p in projects)]),
    }
    return "\n\n".join(["# Persona", *(f"## {k}\n\n{v}" for k, v in parts.items())]) + "\n"


def conclusions_md(summary: list[dict], conclusions: list[dict], model: str, backend: str, n: int) -> str:
    proof = lambda c: f"{c['statement']} — {' '.join(f'#{e}' for e in c['evidence'])}（簇合计 {c['count']} 次 / {c['project_count']} 项目）"
    out = ["# 结论", "", f"- 模型：{model}；聚类：{backend}；输入候选 {n}", NOTE, "", "## 画像总结", "", *([f"- {proof(c)}" for c in summary] or [NONE]), ""]
    for dest, title in DEST_TITLES.items():
        rows = [f"- [{c['kind']}] {proof(c)}" for c in conclusions if c["dest"] == dest]
        out += [f"## {title}（{len(rows)}）", "", *(rows or [NONE]), ""]
    return "\n".join(out).rstrip() + "\n"
