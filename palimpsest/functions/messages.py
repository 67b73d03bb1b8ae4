"""What is said to a person, in the languages of the interface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.constants import LANGUAGES

MESSAGES = {
    "no_files": ("Не выбрано ни одного файла.", "No file was chosen."),
    "too_many_files": ("Слишком много файлов, не больше {max}.", "Too many files; {max} at most."),
    "unsupported_format": ("{name}: такой формат не читается.", "{name}: this format can't be read."),
    "not_ooxml": ("{name}: это не документ Office.", "{name}: this is no Office document."),
    "too_large": ("{name}: содержимое слишком велико.", "{name}: its content is too large."),
    "file_too_large": ("{name}: больше {mb} МБ.", "{name}: larger than {mb} MB."),
    "file_empty": ("{name}: файл пуст.", "{name}: the file is empty."),
    "job_gone": ("Задание не найдено или устарело.", "The job isn't there, or has expired."),
    "nothing_selected": ("Не выбрано ничего, что есть в документах.", "Nothing is selected that the documents have."),
    "mapping_not_json": ("Ключ должен быть файлом JSON.", "The key must be a JSON file."),
    "mapping_empty": ("В ключе нет ни одной метки.", "The key has no tag."),
    "unmapped_tags": ("Меток без значения: {count} ({tags}).", "Tags without a value: {count} ({tags})."),
    "model_failed": ("Модель не ответила: {reason}.", "The model didn't answer: {reason}."),
    "model_no_json": ("В ответе модели нет JSON.", "The model's reply has no JSON."),
    "missing_client_id": ("Не указано, кто спрашивает.", "It isn't said who is asking."),
    "scan_running": ("Документы ещё читаются.", "The documents are still being read."),
    "no_pattern": ("Из выбранного не получается ни одного образца.", "No pattern can be made of what is selected."),
    "replacing_failed": ("Замена не удалась.", "Replacing failed."),
    "restore_failed": ("Восстановление не удалось.", "Restoring failed."),
    "file_not_ready": ("Файла ещё нет.", "The file isn't there yet."),
    "doc_not_ready": ("Документа ещё нет.", "The document isn't there yet."),
    "mapping_unreadable": ("Ключ не читается: {error}.", "The key can't be read: {error}."),
    "mapping_tag_mismatch": ("В ключе метки вида {prefix}…{suffix}, в настройках {server_prefix}…{server_suffix}.", "The key's tags are {prefix}…{suffix}, those of the settings {server_prefix}…{server_suffix}."),
    "no_model": ("Модель не задана: искали только по правилам.", "No model is set: only rules have searched."),
    "chunk_failed": ("Часть {index} из {total} не прочитана: {error}.", "Part {index} of {total} wasn't read: {error}."),
    "model_unreachable": ("Нет связи с {url}: {error}.", "{url} can't be reached: {error}."),
    "model_http_error": ("Модель ответила кодом {status}: {body}.", "The model answered with status {status}: {body}."),
    "model_bad_shape": ("Ответ модели устроен иначе: {body}.", "The model's answer has another shape: {body}."),
    "model_unclosed": ("Модель не закончила рассуждение.", "The model didn't end its thinking."),
}


class _Kept(dict):
    def __missing__(self, key):
        return "{" + key + "}"


def message(key: str, lang: str = LANGUAGES[0], **values: object) -> str:
    """The message of a key, its {places} filled in where a value is given; an unknown key is its own message."""
    texts = MESSAGES.get(key)
    if texts is None:
        return key
    return texts[LANGUAGES.index(lang) if lang in LANGUAGES else 0].format_map(_Kept(values))


def message_column(key: Column, lang: Column) -> Column:
    """The unfilled message of a column of keys."""
    found = [F.create_map(*[F.lit(x) for k, texts in MESSAGES.items() for x in (k, texts[at])]) for at in range(len(LANGUAGES))]
    own = [F.coalesce(F.try_element_at(known, key), key) for known in found]
    out = own[0]
    for code, text in zip(LANGUAGES[1:], own[1:], strict=True):
        out = F.when(lang == code, text).otherwise(out)
    return out
