"""Operators: pure functions DataFrame(s), params -> DataFrame.

cases       first case per (rule, merchant), case review times, turnaround
loss        LOSS: post-case payments, loss per rule, summary, display
precision   PRECISION: spine, flagged / offboarded / deactivated, precision
scoring     current workload, loss attachment, priority scores, reports
assignment  greedy review-type assignment per planning unit, summaries
derive      planning inputs derived from the tables, trends over as-of dates
"""
