"""Lanes and decision marks of process flows."""

# Fixed values.
LANES = ("Client", "Interface", "Application", "Domain", "Data", "External")
LANE_DIRS = (
    ("(^|/)(controllers?|handlers?|routes?|api|endpoints?|resources?|views?|graphql|rpc|web|http|presentation|delivery|transport)(/|$)", "Interface"),
    (r"(^|/)(services?|usecases?|use_cases|application|app|interactors?|commands?|queries|workflows?|orchestrat\w*|jobs?|tasks?|workers?|consumers?|producers?)(/|$)", "Application"),
    ("(^|/)(domain|models?|entities|core|business|logic|aggregates?|value_objects?)(/|$)", "Domain"),
    ("(^|/)(repositor(y|ies)|dao|store|stores|persistence|db|database|data|migrations?|schema|orm|queries|infrastructure/db)(/|$)", "Data"),
    ("(^|/)(clients?|integrations?|adapters?|gateways?|external|providers?|connectors?|sdk)(/|$)", "External"),
    ("(^|/)(components?|pages?|screens?|ui|frontend|templates?|static|assets)(/|$)", "Client"),
)
LANE_FILES = (
    ("(controller|handler|router|route|resolver|endpoint)", "Interface"),
    ("(service|usecase|use_case|interactor|manager|orchestrator|processor)", "Application"),
    ("(model|entity|domain|schema|dto|aggregate)", "Domain"),
    ("(repository|repo|dao|store|db|database|query|migration)", "Data"),
    ("(client|gateway|adapter|integration|provider|connector|api_client)", "External"),
)
DECISIONS = (
    (r"(?i)\b(?:if\s+not\s+\w*auth|unauthorized|forbidden|401|403|require_?auth|is_authenticated|@login_required|authorize|permission)", "Authenticated & authorised?"),
    (r"(?i)\b(?:validate|is_valid|schema\.parse|ValidationError|400|BadRequest|zod\.|pydantic)", "Input valid?"),
    (r"(?i)\b(?:if\s+err\s*!=\s*nil|except\s+\w+|catch\s*\(|rescue|try\s*\{|\.catch\()", "Operation succeeded?"),
    (r"(?i)\b(?:cache\.get|cached|from_cache|redis\.get)", "Cache hit?"),
    (r"(?i)\b(?:exists|find_by|get_or_404|NotFound|404)", "Record found?"),
    (r"(?i)\b(?:rate_?limit|throttle|quota)", "Within rate limit?"),
    (r"(?i)\b(?:idempoten|already_processed|duplicate)", "Already processed?"),
)
