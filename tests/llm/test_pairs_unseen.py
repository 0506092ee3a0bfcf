"""Pairs written after the dictionaries and rules, which were not changed for them: precision and recall."""

from tessera.llm.pairs import defect

EN, DE, FR, ES = "How much revenue did Northwind report for fiscal 2018?", "Wie hoch war der Umsatz von Northwind im Jahr 2018?", "Quel était le chiffre d'affaires de Northwind en 2018 ?", "¿Cuáles fueron los ingresos de Northwind en 2018?"
CASES = [
    (EN, "Northwind reported revenue of $12.4 million for fiscal 2018.", None),
    (EN, "$12.4 million", None),
    (EN, "It was 12.4 million dollars, up from 11.9 million a year before.", None),
    (EN, "Unfortunately the year was weak, but sales still reached $12.4 million.", None),
    (EN, "Revenue for fiscal 2018: $12.4 million [9_2018.htm::chunk2]", None),
    (EN, "How much revenue? Northwind reported $12.4 million for fiscal 2018.", None),
    (EN, "The company does not break out segments; in total it had $12.4 million.", None),
    (EN, "Sales rose because of new stores and higher prices.", None),
    (DE, "Der Umsatz betrug 12,4 Millionen Dollar.", None),
    (DE, "12,4 Mio. Dollar, nach 11,9 Mio. im Vorjahr.", None),
    (FR, "Le chiffre d'affaires s'est élevé à 12,4 millions de dollars.", None),
    (ES, "Los ingresos fueron de 12,4 millones de dólares.", None),
    (EN, "", "empty"),
    (EN, "  \n **Answer:** ", "empty"),
    (EN, "[9_2018.htm::chunk2] [9_2018.htm::chunk3]", "empty"),
    (DE, "---", "empty"),
    (EN, "How much revenue did Northwind report for fiscal 2018?", "copied_question"),
    (EN, "how much revenue did northwind report for fiscal 2018", "copied_question"),
    (EN, "Question: How much revenue did Northwind report, for fiscal 2018?!", "copied_question"),
    (DE, "Wie hoch war der Umsatz von Northwind im Jahr 2018", "copied_question"),
    (EN, "I do not know.", "refusal"),
    (EN, "Sorry, I can't help with this request.", "refusal"),
    (EN, "The excerpts provided contain no figure for that year.", "refusal"),
    (EN, "That could not be determined from the passages.", "refusal"),
    (EN, "We are unable to answer this.", "refusal"),
    (EN, "The supplied documents say nothing about it.", "refusal"),
    (DE, "Das kann ich anhand der Unterlagen leider nicht sagen.", "refusal"),
    (DE, "Dazu habe ich keine Angaben gefunden.", "refusal"),
    (FR, "Je ne peux pas répondre à cette question.", "refusal"),
    (FR, "Je n'ai aucune information à ce sujet.", "refusal"),
    (ES, "No puedo responder a esta pregunta.", "refusal"),
    (ES, "No hay datos sobre ese año.", "refusal"),
    (EN, "Die Umsatzerlöse von Northwind lagen im Geschäftsjahr bei 12,4 Millionen Dollar.", "other_language"),
    (EN, "Le chiffre d'affaires de Northwind s'est élevé à 12,4 millions de dollars pour l'exercice.", "other_language"),
    (EN, "I ricavi di Northwind sono stati pari a 12,4 milioni di dollari nell'esercizio.", "other_language"),
    (EN, "Northwinds intäkter uppgick till 12,4 miljoner dollar under räkenskapsåret.", "other_language"),
    (EN, "Przychody spółki Northwind wyniosły w roku 2018 ponad 12,4 milionów dolarów.", "other_language"),
    (EN, "Northwind の売上高は1240万ドルでした。", "other_language"),
    (DE, "Revenue of Northwind for the year was 12.4 million dollars.", "other_language"),
    (EN, "Northwind reported revenue of $12.4 million for fiscal 2018, which was driven by the open", "truncated"),
    (EN, "Northwind reported revenue of $12.4 million, compared with", "truncated"),
    (EN, "Revenue was $12.4 million. The main reasons were:\n- New stores\n- Hi", "truncated"),
    (EN, "Revenue was $12.4 million [9_2018.htm::ch", "truncated"),
    (EN, "Revenue rose in 2018 because of the", "truncated"),
    (DE, "Der Umsatz betrug 12,4 Millionen Dollar und lag damit über dem", "truncated"),
    (FR, "Le chiffre d'affaires s'est élevé à 12,4 millions de dollars, soit une haus", "truncated"),
]


def test_precision_and_recall():
    said = [(defect(q, a, "answer"), want) for q, a, want in CASES]
    right = sum(got == want for got, want in said if want)
    found, true = sum(got is not None for got, _ in said), sum(want is not None for _, want in said)
    assert right / found >= 0.9 and right / true >= 0.9
