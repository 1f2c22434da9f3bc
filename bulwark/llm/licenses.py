"""License scans by ordered signature rules.

A few hundred regular expressions, each with a priority and a label, are gated by keywords: one Aho-Corasick pass finds which
keywords a text holds, and only the rules of those keywords run.  A detection that lies inside a longer one is dropped;
of detections with the same bounds the one of highest priority stays.

The rules are hand-written: sentences that only license texts and notices hold (``NOTICES``), and for the licenses in ``FAMILIES``
full titles, short names, SPDX identifiers, grants and URLs.  Words of a rule may stand apart by any white space, punctuation and
comment marks, so wrapped headers are found.  Base phrases are counted apart, as consecutive words, and their labels always stay.

Defined cases: null counts as an empty text (no words, no labels, score 0); texts are scanned whole; overlapping base
phrases all count; repeated rows are scanned alike; no other column is read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from bulwark.llm.common import map_batches

#: The phrases whose places are counted, and their labels.
PHRASES = {
    ("gnu", "general", "public", "license"): "gpl",
    ("apache", "license"): "apache",
    ("cc", "by"): "cc-by",
    ("mit", "license"): "mit",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: What may stand between two words of a pattern, however long: white space, punctuation and comment marks, but no letter or digit.
GAP_CLASS = "[^0-9a-z\u00c0-\u1fff\u3040-\U0010ffff]"
GAP = GAP_CLASS + "+"


@dataclass(frozen=True)
class Rule:
    """A signature: the higher ``priority`` wins, ``keyword`` must occur in the text for the pattern to run."""

    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    weight: float


#: label, keyword, title pattern, short names, SPDX identifiers, URL patterns. ``_`` stands for any short gap.
FAMILIES = [
    ("gpl-1.0", "general", "gnu_general_public_licen[sc]e_(?:version_|v)?1(?:\\.0)?", "gpl_?v?1", "gpl-1\\.0(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/(?:old-licenses/)?gpl-1\\.0"),
    ("gpl-2.0", "general", "gnu_general_public_licen[sc]e_(?:version_|v)?2(?:\\.0)?", "gpl_?v?2", "gpl-2\\.0(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0"),
    ("gpl-3.0", "general", "gnu_general_public_licen[sc]e_(?:version_|v)?3(?:\\.0)?", "gpl_?v?3", "gpl-3\\.0(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/gpl(?:-3\\.0)?\\b"),
    ("gpl", "general", "(?:gnu_)?general_public_licen[sc]e", "gnu_gpl", "gpl", "gnu\\.org/copyleft/gpl"),
    ("lgpl-2.0", "general", "gnu_library_general_public_licen[sc]e_(?:version_|v)?2(?:\\.0)?", "lgpl_?v?2(?:\\.0)?(?!\\.1)", "lgpl-2\\.0(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/old-licenses/lgpl-2\\.0"),
    ("lgpl-2.1", "general", "gnu_lesser_general_public_licen[sc]e_(?:version_|v)?2\\.1", "lgpl_?v?2\\.1", "lgpl-2\\.1(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/old-licenses/lgpl-2\\.1"),
    ("lgpl-3.0", "general", "gnu_lesser_general_public_licen[sc]e_(?:version_|v)?3(?:\\.0)?", "lgpl_?v?3", "lgpl-3\\.0(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/lgpl(?:-3\\.0)?\\b"),
    ("lgpl", "general", "(?:lesser|library)_general_public_licen[sc]e", "gnu_lgpl", "lgpl", "gnu\\.org/copyleft/lesser"),
    ("agpl-3.0", "affero", "(?:gnu_)?affero_general_public_licen[sc]e(?:_(?:version_|v)?3(?:\\.0)?)?", "agpl_?v?3", "agpl-3\\.0(?:-only|-or-later|\\+)?", "gnu\\.org/licenses/agpl(?:-3\\.0)?\\b"),
    ("gfdl", "documentation", "gnu_free_documentation_licen[sc]e", "gnu_fdl", "gfdl-1\\.[123](?:-only|-or-later)?", "gnu\\.org/licenses/fdl"),
    ("apache-1.1", "apache", "apache_(?:software_)?licen[sc]e,?_(?:version_|v)?1\\.1", "asl_?1\\.1", "apache-1\\.1", "apache\\.org/licenses/license-1\\.1"),
    ("apache-2.0", "apache", "apache_(?:software_)?licen[sc]e,?_(?:version_|v)?2(?:\\.0)?", "asl_?2\\.0", "apache-2\\.0", "apache\\.org/licenses/license-2\\.0"),
    ("apache", "apache", "apache_(?:software_)?licen[sc]e", "apache_licensed", "apache", "apache\\.org/licenses"),
    ("mit", "mit", "mit_licen[sc]e", "mit_licen[sc]ed", "mit", "opensource\\.org/licenses?/mit"),
    ("mit-0", "mit", "mit_no_attribution", "mit-0_licen[sc]e", "mit-0", "opensource\\.org/licenses?/mit-0"),
    ("bsd-2-clause", "bsd", "(?:bsd_2-clause|2-clause_bsd|simplified_bsd|freebsd)_licen[sc]e", "bsd_?2_clause", "bsd-2-clause(?:-patent)?", "opensource\\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", "(?:bsd_3-clause|3-clause_bsd|new_bsd|modified_bsd|revised_bsd)_licen[sc]e", "bsd_?3_clause", "bsd-3-clause(?:-clear)?", "opensource\\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", "(?:bsd_4-clause|4-clause_bsd|original_bsd)_licen[sc]e", "bsd_?4_clause", "bsd-4-clause", "spdx\\.org/licenses/bsd-4-clause"),
    ("0bsd", "bsd", "(?:zero-clause_bsd|bsd_zero_clause)_licen[sc]e", "free_public_license_1\\.0\\.0", "0bsd", "opensource\\.org/licenses?/0bsd"),
    ("bsd", "bsd", "bsd(?:-style)?_licen[sc]e", "bsd_licen[sc]ed", "bsd", "opensource\\.org/licenses?/bsd-license"),
    ("isc", "isc", "isc_licen[sc]e", "isc_licen[sc]ed", "isc", "opensource\\.org/licenses?/isc"),
    ("mpl-1.1", "mozilla", "mozilla_public_licen[sc]e,?_(?:version_|v\\.?_?)?1\\.1", "mpl_?v?1\\.1", "mpl-1\\.1", "mozilla\\.org/mpl/mpl-1\\.1"),
    ("mpl-2.0", "mozilla", "mozilla_public_licen[sc]e,?_(?:version_|v\\.?_?)?2\\.0", "mpl_?v?2\\.0", "mpl-2\\.0", "mozilla\\.org/(?:en-us/)?mpl/2\\.0"),
    ("mpl", "mozilla", "mozilla_public_licen[sc]e", "mozilla_mpl", "mpl", "mozilla\\.org/mpl"),
    ("epl-1.0", "eclipse", "eclipse_public_licen[sc]e(?:_-)?_(?:version_|v_?)?1\\.0", "epl_?v?1\\.0", "epl-1\\.0", "eclipse\\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", "eclipse_public_licen[sc]e(?:_-)?_(?:version_|v_?)?2\\.0", "epl_?v?2\\.0", "epl-2\\.0", "eclipse\\.org/legal/epl-(?:v20|2\\.0)"),
    ("cddl-1.0", "distribution", "common_development_and_distribution_licen[sc]e", "cddl_?v?1\\.[01]", "cddl-1\\.[01]", "opensource\\.org/licenses?/cddl"),
    ("cc0-1.0", "creative", "creative_commons_zero", "cc0_?1\\.0", "cc0-1\\.0", "creativecommons\\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "creative", "creative_commons_attribution-noncommercial-noderiv(?:ative)?s", "cc_by-nc-nd(?:_[1-4]\\.[05])?", "cc-by-nc-nd-[1-4]\\.[05]", "creativecommons\\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "creative", "creative_commons_attribution-noncommercial-sharealike", "cc_by-nc-sa(?:_[1-4]\\.[05])?", "cc-by-nc-sa-[1-4]\\.[05]", "creativecommons\\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "creative", "creative_commons_attribution-noncommercial", "cc_by-nc(?:_[1-4]\\.[05])?", "cc-by-nc-[1-4]\\.[05]", "creativecommons\\.org/licenses/by-nc\\b"),
    ("cc-by-nd", "creative", "creative_commons_attribution-noderiv(?:ative)?s", "cc_by-nd(?:_[1-4]\\.[05])?", "cc-by-nd-[1-4]\\.[05]", "creativecommons\\.org/licenses/by-nd"),
    ("cc-by-sa", "creative", "creative_commons_attribution-sharealike", "cc_by-sa(?:_[1-4]\\.[05])?", "cc-by-sa-[1-4]\\.[05]", "creativecommons\\.org/licenses/by-sa"),
    ("cc-by", "creative", "creative_commons_attribution", "cc_by(?:_[1-4]\\.[05])?", "cc-by-[1-4]\\.[05]", "creativecommons\\.org/licenses/by\\b"),
    ("unlicense", "unlicense", "the_unlicense", "unlicensed_software", "unlicense", "unlicense\\.org"),
    ("wtfpl", "public", "do_what_the_f[a-z*]{3}_you_want_to_public_licen[sc]e", "wtfpl_?v?2", "wtfpl", "wtfpl\\.net"),
    ("zlib", "zlib", "zlib(?:/libpng)?_licen[sc]e", "zlib_licen[sc]ed", "zlib", "opensource\\.org/licenses?/zlib"),
    ("bsl-1.0", "boost", "boost_software_licen[sc]e", "boost_licen[sc]ed", "bsl-1\\.0", "boost\\.org/license_1_0"),
    ("busl-1.1", "business", "business_source_licen[sc]e", "busl_?1\\.1", "busl-1\\.1", "mariadb\\.com/bsl"),
    ("sspl-1.0", "server", "server_side_public_licen[sc]e", "sspl_?v?1", "sspl-1\\.0", "mongodb\\.com/licensing/server-side-public-license"),
    ("artistic-2.0", "artistic", "artistic_licen[sc]e(?:_2\\.0)?", "artistic_?2\\.0", "artistic-[12]\\.0", "perlfoundation\\.org/artistic"),
    ("python-2.0", "python", "python_software_foundation_licen[sc]e", "psf_licen[sc]e", "(?:python|psf)-2\\.0", "docs\\.python\\.org/[0-9.]{1,4}/license"),
    ("openssl", "openssl", "openssl_licen[sc]e", "openssl/ssleay", "openssl", "openssl\\.org/source/license"),
    ("postgresql", "postgresql", "postgresql_licen[sc]e", "postgresql_licen[sc]ed", "postgresql", "opensource\\.org/licenses?/postgresql"),
    ("ofl-1.1", "sil", "sil_open_font_licen[sc]e", "ofl_?1\\.1", "ofl-1\\.1", "scripts\\.sil\\.org/ofl"),
    ("odbl-1.0", "database", "open_database_licen[sc]e", "odbl_?v?1\\.0", "odbl-1\\.0", "opendatacommons\\.org/licenses/odbl"),
    ("eupl-1.2", "european", "european_union_public_licen[sc]e", "eupl_?v?1\\.[12]", "eupl-1\\.[12]", "joinup\\.ec\\.europa\\.eu/[a-z/]*eupl"),
    ("ms-pl", "microsoft", "microsoft_public_licen[sc]e", "ms-pl_licen[sc]e", "ms-pl", "opensource\\.org/licenses?/ms-pl"),
    ("ncsa", "illinois", "university_of_illinois/ncsa_open_source_licen[sc]e", "ncsa_licen[sc]e", "ncsa", "opensource\\.org/licenses?/ncsa"),
    ("upl-1.0", "universal", "universal_permissive_licen[sc]e", "upl_?1\\.0", "upl-1\\.0", "opensource\\.org/licenses?/upl"),
    ("openrail", "rail", "(?:creativeml_|bigscience_)?open_?rail(?:-m|\\+\\+-m|-s)?", "responsible_ai_licen[sc]e", "openrail(?:\\+\\+)?(?:-m)?", "huggingface\\.co/spaces/bigscience/license"),
]
#: Sentences that only license texts and notices hold: label, keyword, pattern.
NOTICES = [
    ("mit", "permission", "permission_is_hereby_granted,?_free_of_charge,?_to_any_person_obtaining_a_copy"),
    ("isc", "permission", "permission_to_use,?_copy,?_modify,?_and(?:/or)?_distribute_this_software_for_any_purpose"),
    ("bsd", "redistribution", "redistribution_and_use_in_source_and_binary_forms,?_with_or_without_modification"),
    ("bsd-3-clause", "endorse", "neither_the_name_of_(?:(?!neither)[^\\x00])*?endorse_or_promote_products"),
    ("bsd-4-clause", "advertising", "all_advertising_materials_mentioning_features_or_use_of_this_software"),
    ("zlib", "warranty", "this_software_is_provided_'?as-is'?,?_without_any_express_or_implied_warranty"),
    ("gpl", "redistribute", "you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_gnu_general_public_licen[sc]e"),
    ("lgpl", "redistribute", "you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_gnu_(?:lesser|library)_general_public_licen[sc]e"),
    ("agpl-3.0", "redistribute", "you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_gnu_affero_general_public_licen[sc]e"),
    ("apache-2.0", "apache", "licensed_under_the_apache_licen[sc]e,?_version_2\\.0"),
    ("mpl-2.0", "mozilla", "this_source_code_form_is_subject_to_the_terms_of_the_mozilla_public_licen[sc]e"),
    ("unlicense", "unencumbered", "this_is_free_and_unencumbered_software_released_into_the_public_domain"),
    ("public-domain", "public", "(?:released|placed|dedicated)_(?:in|into|to)_the_public_domain"),
    ("proprietary", "rights", "all_rights_reserved"),
    ("proprietary", "confidential", "(?:proprietary_and_confidential|confidential_and_proprietary)"),
    ("bsl-1.0", "boost", "distributed_under_the_boost_software_licen[sc]e"),
    ("ofl-1.1", "font", "this_font_software_is_licen[sc]ed_under_the_sil_open_font_licen[sc]e"),
    # permissive licenses, clause by clause
    ("mit", "sublicense", "rights_to_use,?_copy,?_modify,?_merge,?_publish,?_distribute,?_sublicense"),
    ("mit", "portions", "the_above_copyright_notice_and_this_permission_notice_shall_be_included_in_all_copies_or_substantial_portions_of_the_software"),
    ("mit", "noninfringement", "warranties_of_merchantability,?_fitness_for_a_particular_purpose_and_noninfringement"),
    ("bsd", "redistributions", "redistributions_of_source_code_must_retain_the_above_copyright_notice"),
    ("bsd", "redistributions", "redistributions_in_binary_form_must_reproduce_the_above_copyright_notice"),
    ("bsd", "contributors", "this_software_is_provided_by_the_copyright_holders_and_contributors"),
    ("bsd-4-clause", "acknowledgement", "must_display_the_following_acknowledgement"),
    ("0bsd", "permission", "permission_to_use,?_copy,?_modify,?_and(?:/or)?_distribute_this_software_for_any_purpose_with_or_without_fee_is_hereby_granted\\."),
    ("isc", "disclaims", "the_author_disclaims_all_warranties_with_regard_to_this_software"),
    ("zlib", "altered", "altered_source_versions_must_be_plainly_marked_as_such"),
    ("zlib", "misrepresented", "the_origin_of_this_software_must_not_be_misrepresented"),
    ("bsl-1.0", "boost", "boost_software_licen[sc]e_-_version_1\\.0_-_august_17th,?_2003"),
    ("bsl-1.0", "entire", "the_copyright_notices_in_the_software_and_this_entire_statement"),
    ("postgresql", "postgresql", "postgresql_database_management_system_\\(formerly_known_as_postgres"),
    ("python-2.0", "python", "psf_is_making_python_available_to_licen[sc]ee_on_an_(?:\"|')?as_is"),
    ("openssl", "openssl", "this_product_includes_software_developed_by_the_openssl_project"),
    ("ncsa", "illinois", "names_of_[a-z_]*university_of_illinois"),
    ("hpnd", "permission", "permission_to_use,?_copy,?_modify,?_and_distribute_this_software_and_its_documentation_for_any_purpose"),
    ("curl", "provided", "permission_to_use,?_copy,?_modify,?_and_distribute_this_software_for_any_purpose_with_or_without_fee_is_hereby_granted,?_provided_that"),
    # the GNU family
    ("gpl", "hope", "distributed_in_the_hope_that_it_will_be_useful,?_but_without_any_warranty"),
    ("gpl", "received", "you_should_have_received_a_copy_of_the_gnu_general_public_licen[sc]e"),
    ("lgpl", "received", "you_should_have_received_a_copy_of_the_gnu_(?:lesser|library)_general_public_licen[sc]e"),
    ("agpl-3.0", "received", "you_should_have_received_a_copy_of_the_gnu_affero_general_public_licen[sc]e"),
    ("gpl-2.0", "version", "either_version_2_of_the_licen[sc]e,?_or_\\(?at_your_option\\)?_any_later_version"),
    ("gpl-3.0", "version", "either_version_3_of_the_licen[sc]e,?_or_\\(?at_your_option\\)?_any_later_version"),
    ("lgpl-2.1", "version", "either_version_2\\.1_of_the_licen[sc]e,?_or_\\(?at_your_option\\)?_any_later_version"),
    ("gpl-2.0", "terms", "terms_and_conditions_for_copying,?_distribution_and_modification"),
    ("gpl", "verbatim", "everyone_is_permitted_to_copy_and_distribute_verbatim_copies_of_this_licen[sc]e_document"),
    ("agpl-3.0", "interacting", "offer_all_users_interacting_with_it_remotely_through_a_computer_network"),
    ("gfdl", "invariant", "no_invariant_sections,?_no_front-cover_texts,?_and_no_back-cover_texts"),
    ("gpl", "exception", "as_a_special_exception,?_the_copyright_holders"),
    ("classpath-exception", "linking", "linking_this_library_statically_or_dynamically_with_other_modules"),
    # weak copyleft and vendor licenses
    ("apache-2.0", "apache", "you_may_not_use_this_file_except_in_compliance_with_the_licen[sc]e\\._you_may_obtain_a_copy_of_the_licen[sc]e_at_https?://www\\.apache\\.org"),
    ("apache-2.0", "apache", "licen[sc]ed_to_the_apache_software_foundation"),
    ("apache-1.1", "apache", "this_product_includes_software_developed_by_the_apache_software_foundation"),
    ("apache-2.0", "perpetual", "hereby_grants_to_you_a_perpetual,?_worldwide,?_non-exclusive,?_no-charge,?_royalty-free,?_irrevocable_(?:copyright|\\(except)"),
    ("mpl-1.1", "mozilla", "the_contents_of_this_file_are_subject_to_the_mozilla_public_licen[sc]e"),
    ("mpl-2.0", "incompatible", "incompatible_with_secondary_licen[sc]es"),
    ("epl-2.0", "eclipse", "this_program_and_the_accompanying_materials_are_made_available_under_the_terms_of_the_eclipse_public_licen[sc]e_(?:v_?)?2"),
    ("epl-1.0", "eclipse", "this_program_and_the_accompanying_materials_are_made_available_under_the_terms_of_the_eclipse_public_licen[sc]e_(?:v_?)?1"),
    ("cddl-1.0", "cddl", "when_distributing_covered_code,?_include_this_cddl_header"),
    ("cpl-1.0", "common", "common_public_licen[sc]e(?:_version_|_v)_?1\\.0"),
    ("ms-rl", "reciprocal", "microsoft_reciprocal_licen[sc]e"),
    ("artistic-1.0", "artistic", "the_intent_of_this_document_is_to_state_the_conditions_under_which_a_package_may_be_copied(?:(?!copied)[^.])*?artistic"),
    ("php-3.01", "php", "this_product_includes_php_software"),
    ("ruby", "ruby", "you_can_redistribute_it_and/or_modify_it_under_either_the_terms_of_the_2-clause_bsdl?(?:(?!clause)[^.])*?ruby"),
    ("vim", "vim", "vim_licen[sc]e"),
    ("afl-3.0", "academic", "academic_free_licen[sc]e(?:_version_|_v)_?3\\.0"),
    ("osl-3.0", "open", "open_software_licen[sc]e(?:_version_|_v)_?3\\.0"),
    ("eupl-1.2", "eupl", "licen[sc]ed_under_the_eupl"),
    # dedications
    ("cc0-1.0", "waived", "to_the_extent_possible_under_law,?_(?:(?!possible)[^.])*?waived_all_copyright"),
    ("cc0-1.0", "dedication", "cc0_(?:1\\.0_)?(?:universal_)?(?:\\(cc0_1\\.0\\)_)?public_domain_dedication"),
    ("unlicense", "anyone", "anyone_is_free_to_copy,?_modify,?_publish,?_use,?_compile,?_sell,?_or_distribute_this_software"),
    ("wtfpl", "fuck", "you_just_do_what_the_fuck_you_want_to"),
    ("public-domain", "public", "this_(?:work|file|program|software)_is_in_the_public_domain"),
    # creative works and data
    ("cc-by", "creative", "this_work_is_licen[sc]ed_under_a_creative_commons_attribution_[1-4]\\.[05]_international_licen[sc]e"),
    ("cc-by-sa", "remix", "if_you_remix,?_transform,?_or_build_upon_the_material,?_you_must_distribute_your_contributions_under_the_same_licen[sc]e"),
    ("cc-by-nc", "commercial", "you_may_not_use_the_material_for_commercial_purposes"),
    ("cc-by-nd", "remix", "if_you_remix,?_transform,?_or_build_upon_the_material,?_you_may_not_distribute_the_modified_material"),
    ("odbl-1.0", "database", "is_made_available_under_the_open_database_licen[sc]e"),
    ("odc-by-1.0", "commons", "open_data_commons_attribution_licen[sc]e"),
    ("pddl-1.0", "public", "open_data_commons_public_domain_dedication_and_licen[sc]e"),
    ("cdla-permissive-2.0", "community", "community_data_licen[sc]e_agreement_-_permissive_-_version_2\\.0"),
    ("ogl-3.0", "government", "open_government_licen[sc]e_v3\\.0"),
    # source-available, models, and closed terms
    ("busl-1.1", "production", "make_production_use_of_the_licen[sc]ed_work"),
    ("sspl-1.0", "service", "offering_the_program_as_a_service"),
    ("elastic-2.0", "elastic", "elastic_licen[sc]e_2\\.0"),
    ("elastic-2.0", "managed", "you_may_not_provide_the_software_to_third_parties_as_a_hosted_or_managed_service"),
    ("polyform-noncommercial-1.0.0", "polyform", "polyform_noncommercial_licen[sc]e_1\\.0\\.0"),
    ("commons-clause", "commons", "commons_clause_licen[sc]e_condition_v1\\.0"),
    ("openrail", "rail", "use-based_restrictions_(?:(?!restrictions)[^.])*?open_?rail"),
    ("llama", "llama", "llama_[0-9.]*_?community_licen[sc]e_agreement"),
    ("gemma", "gemma", "gemma_is_provided_under_and_subject_to_the_gemma_terms_of_use"),
    ("proprietary", "permission", "may_not_be_reproduced,?_(?:distributed|transmitted)(?:(?!reproduced)[^.])*?without_(?:the_)?(?:prior_|express_)?written_permission"),
    ("proprietary", "unauthorized", "unauthorized_copying_of_this_file,?_via_any_medium,?_is_strictly_prohibited"),
    ("proprietary", "contains", "contains_(?:trade_secrets|confidential_information)_of"),
]


def compiled(pattern: str) -> re.Pattern:
    return re.compile(r"(?<![0-9a-z])" + re.sub(r"_(?![?])", lambda _: GAP, pattern.replace("_?", GAP_CLASS + "{0,3}")) + r"(?![0-9a-z])")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every signature, in order of priority: notices, SPDX tags, grants and headers, URLs, titles, short names."""
    out = [Rule(label, 60, keyword, compiled(p), 1.0) for label, keyword, p in NOTICES]
    for label, keyword, title, short, spdx, url in FAMILIES:
        versioned = 1 if any(c.isdigit() for c in label) or label.count("-") > 1 else 0
        out += [
            Rule(label, 50 + versioned, "spdx", compiled(f"spdx-license-identifier_{spdx}"), 1.0),
            Rule(label, 48 + versioned, "license:", compiled(f"license:_?{spdx}"), 0.9),
            Rule(label, 40 + versioned, "licensed", compiled(f"licensed_under_(?:the_)?(?:terms_of_(?:the_)?)?(?:{title}|{short}|{spdx})"), 0.95),
            Rule(label, 40 + versioned, "released", compiled(f"released_under_(?:the_|an?_)?(?:{title}|{short}|{spdx})"), 0.9),
            Rule(label, 40 + versioned, "distributed", compiled(f"distributed_under_(?:the_|an?_)?(?:terms_of_(?:the_)?)?(?:{title}|{short}|{spdx})"), 0.9),
            Rule(label, 30 + versioned, url.replace("\\", "").split(".")[0].split("/")[0], compiled(url), 0.9),
            Rule(label, 20 + versioned, keyword, compiled(title), 0.8),
            Rule(label, 10 + versioned, re.split(r"[^a-z0-9]", short.replace("(?:", ""))[0], compiled(short), 0.6),
        ]
    return tuple(sorted(out, key=lambda r: -r.priority))


class Scanner:
    """All rules behind one automaton of their keywords."""

    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, rule in enumerate(rules()):
            by.setdefault(rule.keyword, []).append(k)
        for keyword, ks in by.items():
            self.words.add_word(keyword, tuple(ks))
        self.words.make_automaton()

    def detect(self, text: str) -> list[tuple[int, int, Rule]]:
        """Detections left after containment; ``text`` is in lower case."""
        gated = sorted({k for _, ks in self.words.iter(text) for k in ks})
        found = [(m.start(), m.end(), rules()[k]) for k in gated for m in rules()[k].pattern.finditer(text)]
        found.sort(key=lambda d: (d[0], -d[1], -d[2].priority))
        kept: list[tuple[int, int, Rule]] = []
        active: list[tuple[int, int, Rule]] = []
        for d in found:  # whatever contains d starts no later, and ends no earlier
            active = [a for a in active if a[1] > d[0]]
            if not any(a[1] >= d[1] for a in active):
                active.append(d)
                kept.append(d)
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """One scanner for all tasks that a Python worker runs."""
    return Scanner()


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in PHRASES.items():
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + len(phrase)]) == phrase:
                out.append((at, label))
    return out


LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}


def scan(text: str | None) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    text = text or ""
    text = text.lower() if text.isascii() else text.translate(LOWER)
    words = WORD.findall(text)
    places = base_places(words)
    detections = scanner().detect(text)
    base = {label for _, label in places}
    starts = [at for at, _ in places]
    score = max([0.8] * bool(base) + [d[2].weight for d in detections], default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[2].label for d in detections})), score


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COLUMNS`` of every whole text."""

    def make():
        def each(batch: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame([scan(t) for t in batch["text"]], columns=[*COLUMNS])
            out = out.astype({"first_word": "Int64", "last_word": "Int64"})
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            return out

        return each

    return map_batches(docs, ["doc_id", "text"], "doc_id long, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()), make)
