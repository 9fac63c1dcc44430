"""DataFrame operators: candidate narrowing, rules, classifier, detection, breakdown."""
