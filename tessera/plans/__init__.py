"""Registered queries: derived views, plans and their SQL."""

from tessera.plans import align_plans, convert_plans, corpus_plans, pair_plans, text_plans

#: name -> (query, its SQL or None)
PLANS = {**pair_plans.PLANS, **corpus_plans.PLANS, **text_plans.PLANS, **convert_plans.PLANS, **align_plans.PLANS}
